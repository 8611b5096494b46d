"""What Python steps hold does not grow with a batch, and intermediate results of many small partitions are few files."""

import random
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from netdensity.llm import common, near  # noqa: E402
from netdensity.session import WAVES, checkpoint_dir, fewer  # noqa: E402


def test_slices_hold_all_rows_in_order():
    texts = ["a" * 30, None, "", "b" * 500, *["c" * 40] * 9, None]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(t)), pa.int64()), pa.array(t, pa.string())], ["k", "t"]) for t in (texts, [], [None], texts[:3])]
    got = list(common.lean(iter(batches), 1, 100))
    assert [t for b in got for t in b.column(1).to_pylist()] == [*texts, None, *texts[:3]]
    assert len(got) > 6 and all(sum(len(t or "") for t in b.column(1).to_pylist()[1:]) <= 100 for b in got)


def test_prints_of_a_large_batch_come_in_pieces():
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(400)) for _ in range(1500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["th", "t"])
    out = list(near.prints(iter([batch]), np.zeros(near.BUCKETS, np.int8)))
    assert len(out) > 2 and max(map(len, out)) < 500
    assert [k for b in out for k in b.column(0).to_pylist()] == list(range(len(texts)))
    one = next(near.prints(iter([batch.slice(700, 1)]), np.zeros(near.BUCKETS, np.int8)))
    assert pa.Table.from_batches(out).slice(700, 1).to_pylist() == one.to_pylist()


def test_near_stage_keeps_its_results_in_few_files(spark, tmp_path):
    """Each checkpoint file of a local folder starts two processes of the executor: 60 partitions give no 60 files."""
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(3000)}" for _ in range(60)) for _ in range(150)]
    rows = [(k, t, "en", "s", len(t)) for k, t in enumerate([*texts, *(t + " more" for t in texts)])]
    folder = Path(urlparse(checkpoint_dir(spark)).path)
    folder = Path(urlparse(spark.sparkContext._jsc.sc().getCheckpointDir().get()).path) if not list(folder.glob("rdd-*")) else folder
    before, conf = set(folder.glob("rdd-*")), {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "docs"))
        docs = spark.read.parquet(str(tmp_path / "docs"))
        assert fewer(docs.repartition(60), docs).rdd.getNumPartitions() == min(60, WAVES * spark.sparkContext.defaultParallelism)
        kept = corpus_pipeline.near_stage(spark, docs, "").collect()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert sorted(r.doc_id for r in kept) == list(range(len(texts)))
    files = [len(list(f.glob("part-*"))) for f in set(folder.glob("rdd-*")) - before]
    assert len(files) > 5 and max(files) <= WAVES * spark.sparkContext.defaultParallelism
