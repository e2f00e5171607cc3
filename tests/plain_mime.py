"""One RFC 822 message to headers and parts with the standard library: what the engine is held against."""

from __future__ import annotations

from email import message_from_bytes, policy
from email.header import decode_header, make_header
from email.message import Message
from email.utils import getaddresses, parsedate_to_datetime


def _decoded(value: str) -> str:
    try:
        return str(make_header(decode_header(value)))
    except (LookupError, UnicodeError, ValueError):
        return value


def _text(part: Message) -> str:
    """Text of a part that is indexed. A charset that is missing or unknown is taken as UTF-8, and what
    cannot be decoded is replaced, so one bad byte costs one character and never the message."""
    if part.get_content_type() not in ("text/plain", "text/html"):
        return ""
    raw = part.get_payload(decode=True) or b""
    try:
        text = raw.decode(part.get_content_charset() or "utf-8", "replace")
    except (LookupError, ValueError):
        text = raw.decode("utf-8", "replace")
    return text.replace("\r\n", "\n")


def _leaves(message: Message, depth: int | None):
    """Parts in order: all leaves, or with ``depth=1`` only the direct children."""
    if not message.is_multipart():
        yield message
    elif depth == 1:
        yield from message.get_payload()
    else:
        yield from (p for p in message.walk() if not p.is_multipart())


def parse_message(content: bytes, depth: int | None = None) -> dict:
    """Headers, parts, sender list and sent time (UTC). Raises if there are no headers."""
    message = message_from_bytes(content, policy=policy.compat32)
    headers = [{"name": n, "value": _decoded(str(v))} for n, v in message.items()]
    if not headers:
        raise ValueError("no headers")
    parts = []
    for idx, part in enumerate(_leaves(message, depth)):
        kind = str(part.get("Content-Type") or part.get_content_type())
        text = "" if part.is_multipart() else _text(part)
        parts.append({"idx": idx, "content_type": " ".join(kind.split()), "text": text})
    senders = [
        f"{name} <{address}>" if name else address
        for name, address in getaddresses([_decoded(str(v)) for v in message.get_all("From", [])])
        if name or address
    ]
    return {
        "headers": headers,
        "multipart": message.is_multipart(),
        "parts": parts,
        "subject": next((h["value"] for h in headers if h["name"].lower() == "subject"), None),
        "from": senders,
        "sent": _sent(message),
    }


def _sent(message: Message):
    try:
        return parsedate_to_datetime(str(message["Date"])) if message["Date"] else None
    except (TypeError, ValueError):
        return None
