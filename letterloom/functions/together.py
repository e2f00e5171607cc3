"""What the queries of a batch find in a document, for many documents at once: sums of misspelt words, words near each other.

Rows come sorted by document. The functions travel with the task, with what the batch asks for as a broadcast value.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

# Numbers that a table of documents and patterns, or of documents and clauses, holds at once.
CELLS = 1 << 21
# Scores are rounded to 6 places after they are summed up here; those that may round alike are kept.
ROUNDED = 2e-6


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()


def whole_documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole documents, with the rows at which one starts."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([held, table]).combine_chunks() if held is not None else table
        starts = np.concatenate([[0], np.flatnonzero(np.diff(_codes(table["doc_id"]))) + 1])
        held = table.slice(starts[-1])
        if len(starts) > 1:
            yield table.slice(0, starts[-1]), starts[:-1]
    if held is not None:
        yield held, np.zeros(1, np.int64)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def best_sums(asked, best: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``doc_id, patterns, part`` rows, one for each word, to ``doc_id, query, weight, counted``, the sums of a query's clauses in a document, of those documents
    of a task that can be among the ``best`` so many of a query.

    ``asked`` is a broadcast dict of arrays: for each clause, sorted by query, its ``pattern``, ``weight`` and ``counted``; for each query
    its number, its ``first`` clause and its count ``scoring``. Patterns are numbered from 0 to ``n_patterns``.
    """

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = asked.value
        width, clause, first, scoring = a["n_patterns"], a["pattern"], a["first"], np.maximum(a["scoring"], 1)
        most = max(1, CELLS // max(width, len(clause), 1))
        top = np.full((len(first), best), -np.inf)
        kept: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]] = []

        def least() -> np.ndarray:
            return np.where(np.isfinite(top[:, -1]), top[:, -1] - ROUNDED * (1 + 1e-9 * abs(np.maximum(top[:, -1], 0))), -np.inf)

        for table, starts in whole_documents(batches):
            lists = table["patterns"].combine_chunks()
            patterns, each = lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)
            begin = np.cumsum(each) - each
            part, ends = table["part"].to_numpy(), np.append(starts[1:], table.num_rows)
            for at in range(0, len(starts), most):
                n = min(most, len(starts) - at)
                own = slice(starts[at], ends[at + n - 1])
                sizes = each[own]
                row = np.repeat(np.arange(n), (ends - starts)[at : at + n])
                cell = np.repeat(row * width, sizes) + patterns[begin[own.start] : begin[own.start] + sizes.sum()]
                units = np.bincount(cell, np.repeat(part[own], sizes), n * width).reshape(n, width)
                met = (units > 0 if (part[own] > 0).all() else np.bincount(cell, minlength=n * width).reshape(n, width) > 0)[:, clause]
                weight = np.add.reduceat((units / 1e9)[:, clause] * a["weight"], first, axis=1)
                counted = np.add.reduceat(met * a["counted"], first, axis=1)
                score = np.where(counted > 0, weight * counted / scoring, -np.inf)
                top = -np.sort(-np.concatenate([top, score.T], axis=1), axis=1)[:, :best]
                doc, query = np.nonzero((counted > 0) & (score >= least()))
                kept.append((table["doc_id"].take(pa.array(starts[at : at + n][doc])).combine_chunks(), query, weight[doc, query], counted[doc, query]))
        for doc_ids, query, weight, counted in kept:
            some = np.flatnonzero(weight * counted / scoring[query] >= least()[query])
            columns = [a["queries"][query[some]], weight[some], counted[some]]
            yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(some)), *map(pa.array, columns)], ["doc_id", "query", "weight", "counted"])

    return summed


def likely_words(asked) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``field, term, df`` rows to those that may share a spelling with a pattern of their field, with the ``patterns`` to hold them against.

    ``asked`` is a broadcast dict: ``letters``, so many first letters count, and for each field under ``by_field`` the arrays that
    :func:`spelt` gives of its patterns, sorted by ``key``.
    """

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = asked.value
        for batch in batches:
            fields, terms = batch.column("field").to_numpy(zero_copy_only=False), batch.column("term").to_pylist()
            sizes, found = np.array([len(t) for t in terms]), [np.empty(0, np.int64)]
            keys = keys_of(terms, a["letters"])
            for field, own in a["by_field"].items():
                row = np.flatnonzero(fields == field)
                wanted = keys[row]
                first = np.searchsorted(own["keys"], wanted)
                row, spelling = np.nonzero(own["keys"][np.minimum(first, len(own["keys"]) - 1)] == wanted)
                at = first[row, spelling]
                row = np.flatnonzero(fields == field)[row]
                entry = spread(own["starts"][at], own["counts"][at])
                row = np.repeat(row, own["counts"][at])
                fits = abs(sizes[row] - own["length"][entry]) <= own["edits"][entry]
                found.append(row[fits] << 32 | own["pattern"][entry[fits]])
            pairs = np.unique(np.concatenate(found))
            some, starts = np.unique(pairs >> 32, return_index=True)
            offsets = np.append(starts, len(pairs)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array((pairs & 0xFFFFFFFF).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(some)).columns, lists], [*batch.schema.names, "patterns"])

    return likely


# A letter's share in a key, by its place: odd numbers of 64 bits.
_SHARES = np.random.default_rng(7).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def keys_of(words: list[str], letters: int) -> np.ndarray:
    """A row for each word: keys of what is left of its first letters when none, one or two of them are lost, in the order of :func:`losses`.
    Equal spellings have equal keys; others may by chance."""
    codes = np.array([w[:letters] for w in words] or [""], f"U{letters}").view(np.uint32).reshape(-1, letters).astype(np.uint64)[: len(words)]
    # sums up to each place of letters that stand where they stood, or one or two places before that
    before = [np.concatenate([np.zeros((len(codes), 1), np.uint64), np.cumsum(codes[:, back:] * _SHARES[: letters - back], axis=1, dtype=np.uint64)], axis=1) for back in range(3)]
    # the share of the letters from one place to another, moved back by so many
    moved = lambda back, start, end: before[back][:, max(end - back, 0)] - before[back][:, max(start - back, 0)]
    out = [moved(0, 0, letters)]
    for lost in losses(letters)[1:]:
        ends = [*lost, letters]
        key = moved(0, 0, ends[0])
        for back, (at, end) in enumerate(zip(lost, ends[1:], strict=True), 1):
            key = key + moved(back, at + 1, end)
        out.append(key)
    return np.stack(out, axis=1)


def losses(letters: int) -> list[tuple[int, ...]]:
    """Which of the first letters are lost: none, one, two."""
    return [(), *((i,) for i in range(letters)), *((i, j) for i in range(letters) for j in range(i + 1, letters))]


def spelt(words: list[str], numbers: list[int], edits: list[int], letters: int) -> dict[str, np.ndarray]:
    """What patterns are looked up by: sorted ``keys``, and the ``pattern, length, edits`` of each key from ``starts`` on, ``counts`` of them."""
    lost = np.array([len(at) for at in losses(letters)])
    word, spelling = np.nonzero(lost <= np.array(edits)[:, None])
    keys = keys_of(words, letters)[word, spelling]
    order = np.argsort(keys, kind="stable")
    known, starts, counts = np.unique(keys[order], return_index=True, return_counts=True)
    word = word[order]
    values = {"pattern": np.array(numbers, np.int64), "length": np.array([len(w) for w in words]), "edits": np.array(edits)}
    return {"keys": known, "starts": starts, "counts": counts} | {c: v[word] for c, v in values.items()}


def near_words(asked) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``doc_id, len, part, pos`` rows, sorted by the first two, to ``doc_id, len, phrase, freq``: at how many places of its first word a phrase
    of two words starts a match.

    ``asked`` is a broadcast dict: ``parts`` (sorted), and for each ``gap, slop`` under ``phrases`` the arrays ``first, second`` (places in
    parts), ``phrase`` and ``leads`` (whether the first word is the phrase's rarest), sorted by the words. Both words' positions, less the gap, lie within the slop.
    """

    def count(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        a = asked.value
        n_parts = len(a["parts"])
        changes = np.zeros(table.num_rows, bool)
        changes[starts] = True
        changes[1:] |= np.diff(_codes(table["len"])) != 0
        rows = np.flatnonzero(changes)  # the first row of each document and length
        doc = np.cumsum(changes) - 1
        part = np.searchsorted(a["parts"], table["part"].to_numpy())
        lists = table["pos"].combine_chunks()
        sizes, flat = lists.value_lengths().to_numpy(), lists.flatten().to_numpy().astype(np.int64)
        # lists of each word in its document: more than one if the document came several times
        held, own, times = np.unique(doc * n_parts + part, return_inverse=True, return_counts=True)
        reach = max(gap + slop for gap, slop in a["phrases"])
        span = int(flat.max(initial=0)) + reach + 1

        def beside(key: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            """Places in a sorted key and others after them within reach, with their distance."""
            for step in range(1, len(key)):
                far = key[step:] - key[:-step]
                at = np.flatnonzero(far <= reach)
                if not len(at):
                    return
                yield at, at + step, far[at]

        once = np.repeat(times[own] == 1, sizes)
        key = (np.repeat(doc, sizes) * span + flat)[once]
        order = np.argsort(key, kind="stable")
        key, word, where = key[order], np.repeat(part, sizes)[once][order], np.repeat(doc, sizes)[once][order]
        near = list(beside(key))
        for (gap, slop), p in a["phrases"].items():
            codes, hits = p["first"] * n_parts + p["second"], []
            for left, right, far in near:
                for one, other, ahead in ((left, right, far), (right, left, -far)):
                    fits = abs(ahead - gap) <= slop
                    one, code = one[fits], word[one[fits]] * n_parts + word[other[fits]]
                    found = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                    same = codes[found] == code
                    hits.append(one[same] * len(codes) + found[same])
            places = np.unique(np.concatenate([np.empty(0, np.int64), *hits]))
            pairs, freq = np.unique(where[places // len(codes)] * len(codes) + places % len(codes), return_counts=True)
            more = [(pairs // len(codes), pairs % len(codes), freq)]
            if (times == 2).any():
                more += twice(p, gap, slop, doc, part, own, times, held, sizes, flat, span, n_parts, beside)
            for d, found, f in more:
                at = pa.array(rows[d])
                yield pa.RecordBatch.from_arrays(
                    [table["doc_id"].take(at).combine_chunks(), table["len"].take(at).combine_chunks(), pa.array(p["phrase"][found], pa.int64()), pa.array(f, pa.int64())],
                    ["doc_id", "len", "phrase", "freq"],
                )

    def twice(p, gap, slop, doc, part, own, times, held, sizes, flat, span, n_parts, beside) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A document that came twice and holds only a phrase's rarest word counts that word, beside itself, for both."""
        ends = np.cumsum(sizes)
        # the first in order of a word's two lists
        lists: dict[int, list[int]] = {}
        for r in np.flatnonzero(times[own] == 2):
            lists.setdefault(int(own[r]), []).append(int(r))
        row = np.array([min(rs, key=lambda r: flat[ends[r] - sizes[r] : ends[r]].tolist()) for rs in lists.values()])
        key = np.repeat(np.arange(len(row)) * span, sizes[row]) + flat[spread(ends[row] - sizes[row], sizes[row])]
        for word, other, at, leads in ((p["first"], p["second"], 0, p["leads"]), (p["second"], p["first"], gap, ~p["leads"])):
            starts = [np.empty(0, np.int64)]
            for left, right, far in beside(key):
                starts += [left[abs(far - at) <= slop], right[abs(-far - at) <= slop]]
            freq = np.bincount(key[np.unique(np.concatenate(starts))] // span, minlength=len(row))
            order = np.argsort(word, kind="stable")
            for r, f in zip(row[freq > 0], freq[freq > 0], strict=True):
                some = order[slice(*np.searchsorted(word[order], [part[r], part[r] + 1]))]
                some = some[leads[some] & (other[some] != part[r])]
                some = some[~np.isin(doc[r] * n_parts + other[some], held)]
                yield np.full(len(some), doc[r]), some, np.full(len(some), f)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_documents(batches):
            yield from count(table, starts)

    return counted
