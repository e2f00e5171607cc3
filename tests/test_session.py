import os

from letterloom.session import drop_written, own_folder, written


def test_written_tables_can_be_dropped(spark):
    frame = written(spark.range(3), "some")
    folder = own_folder(spark).removeprefix("file:")
    assert frame.count() == 3 and os.path.isdir(folder)
    drop_written(spark)
    assert not os.path.exists(folder)
    assert written(spark.range(2), "more").count() == 2
