import uuid

import numpy as np
import pytest

from basketwise.llm import sketch


def jobs_of(spark, run):
    """What ``run`` gives and how many jobs it took."""
    group = f"sketch-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


@pytest.fixture
def many_partitions(spark):
    held = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield 48
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("at_least", [1, 2])
def test_jobs_of_a_sketch_do_not_grow_with_the_shuffle_partitions(spark, many_partitions, at_least):
    """One job a shuffle partition filled the driver and merged the blocks one after the other."""
    ids = [(i,) for i in [*range(3000), *range(500)]]
    spec = sketch.SketchSpec(bits=22, rows=2)
    rows = spark.createDataFrame(ids, "id long").repartition(5)
    bits, jobs = jobs_of(spark, lambda: sketch.build(
        rows, lambda batch: iter([sketch.id_hashes(batch.column(0))]), spec, at_least))
    assert jobs <= sketch.PIECES + 8 < many_partitions
    whole = np.array([i for i, in ids]).astype(np.uint64)
    hashes = sketch.mix(whole + sketch.U64(sketch.BASES[0]))
    wanted = np.zeros((spec.rows, 1 << spec.bits), dtype=bool)
    for r in range(spec.rows):
        wanted[r] = np.bincount(sketch._cells(hashes, r, spec), minlength=1 << spec.bits) >= at_least
    assert (bits == np.packbits(wanted, axis=1, bitorder="little")).all()


def test_sketch_of_few_or_no_rows(spark):
    spec = sketch.SketchSpec(bits=21)
    for ids in ([], [(None,)], [(7,)]):
        rows = spark.createDataFrame(ids, "id long").coalesce(1)
        bits = sketch.id_filter(rows, spec)
        assert np.unpackbits(bits).sum() == sum(i is not None for i, in ids)
