"""The log of runs behind streamed pair counts: folders, repeated batches, failures between a run and its manifest."""

import math
import os

from pyspark.sql import functions as F

from karyoloom.streaming import pairs as SP


def batch(spark, k):
    return spark.createDataFrame([("s", "c", int(k % 7), 9, float(k + 1)), ("s", "c", int(k), 50, 1.0)], "sample string, chrom string, i bigint, j bigint, cnt double")


def test_fifty_batches_leave_few_runs(spark, tmp_path, monkeypatch):
    out, n = str(tmp_path / "log"), 50
    failing = {9, 15, 31}
    for k in range(n):
        if k in failing:
            real = SP._read                                        # fails after the run, before its manifest
            calls = []

            def broken(s, path):
                calls.append(path)
                if len(calls) > 2:
                    raise RuntimeError("lost")
                return real(s, path)
            monkeypatch.setattr(SP, "_read", broken)
            try:
                SP.add_batch(batch(spark, k), k, out)
                raise AssertionError("should have failed")
            except RuntimeError:
                pass
            monkeypatch.setattr(SP, "_read", real)
        assert SP.add_batch(batch(spark, k), k, out)
        if k % 11 == 0:
            assert not SP.add_batch(batch(spark, k), k, out)       # delivered again
    runs = SP.live_runs(spark, out)
    most = (SP.FAN - 1) * (math.floor(math.log(n, SP.FAN)) + 1)
    assert len(runs) <= most
    folders = sum(len(d) for _, d, _ in os.walk(out + "/runs")) - len(os.listdir(out + "/runs"))
    assert folders <= 2 * most                                     # a second copy of each slot at most
    got = {(r.i, r.j): r.cnt for r in SP.totals(spark, out).collect()}
    want = {}
    for k in range(n):
        for i, j, c in ((k % 7, 9, k + 1), (k, 50, 1)):
            want[i, j] = want.get((i, j), 0) + c
    assert got == want


def test_a_lost_manifest_leaves_the_one_before(spark, tmp_path):
    out = str(tmp_path / "log")
    for k in range(6):
        SP.add_batch(batch(spark, k), k, out)
    before = SP.totals(spark, out).agg(F.sum("cnt")).first()[0]
    latest = max((0, 1), key=lambda k: max(r["batch"] for r in SP._read(spark, f"{out}/manifest-{k}")))
    for f in os.listdir(f"{out}/manifest-{latest}"):               # a replacement that failed half-way
        os.remove(f"{out}/manifest-{latest}/{f}")
    done, _ = SP.manifest(spark, out)
    assert done == 4 and SP.totals(spark, out).agg(F.sum("cnt")).first()[0] == before - 7
    assert SP.add_batch(batch(spark, 5), 5, out)
    assert SP.totals(spark, out).agg(F.sum("cnt")).first()[0] == before
