"""Ranges of ordered sequences."""

import pathlib
import uuid

from feedpulse.operators.prefix import PART, ordered_parts


def test_rows_are_computed_once(spark, tmp_path):
    """Sampling the bounds of the ranges must not compute the rows a second time."""
    folder = str(tmp_path)

    def note(batches):
        for batch in batches:
            pathlib.Path(folder, uuid.uuid4().hex).write_text(str(batch.num_rows))
            yield batch
    rows = spark.range(0, 1000, 1, 4).mapInArrow(note, "id long")
    out = ordered_parts(rows, ["id"], ["id"], parts=5)
    assert out.count() == 1000 and out.select(PART).distinct().count() == 5
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 1000
