"""The stored blocks of a large scan task are read and written in small row groups."""

import random
from glob import glob

import pyarrow.parquet as pq

from crawlens.llm import blocks as B


def test_row_groups_do_not_grow_with_the_scan_task(spark):
    rng = random.Random(5)
    rows = [(i, rng.randbytes(90_000).hex()) for i in range(400)]  # 72 MB that hardly compress, in one task
    made = B.blocks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    files = [f.removeprefix("file:") for f in made.frame.inputFiles()]
    sizes = [(m.num_rows, m.total_byte_size) for f in files for p in glob(f) for m in (pq.ParquetFile(p).metadata.row_group(g) for g in range(pq.ParquetFile(p).metadata.num_row_groups))]
    assert sum(n for n, _ in sizes) == made.frame.count() > 30 and max(size for _, size in sizes) < 4 * B.ROW_GROUP
    assert sorted(i for r in made.frame.select("ids").collect() for i in r["ids"]) == list(range(400))
