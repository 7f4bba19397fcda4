"""Files known by a manifest: the same rows as a scan that opens them, of fewer files."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from lakes import CALLS, RUN1, RUN2, build
from oracle import spark_rows

from cohortsift.sources.lake import Lake, scan_files
from cohortsift.sources.manifest import AT_ONCE, Manifest


def put(path, **columns):
    pq.write_table(pa.table(columns), path)
    return str(path)


@pytest.fixture
def manifest(spark, tmp_path):
    return Manifest(spark, str(tmp_path / "manifest"))


@pytest.fixture
def numbered(tmp_path):
    """Eight files, whose ids follow each other; text, dates and doubles in step, and a column of NULLs."""
    day = datetime.date(2020, 1, 1)
    names = []
    for k in range(8):
        ids = list(range(10 * k, 10 * k + 10))
        names.append(
            put(
                tmp_path / f"part {k}.parquet",
                id=pa.array(ids, pa.int64()),
                name=pa.array([f"n{i:03}" for i in ids[:-1]] + [None]),
                day=pa.array([day + datetime.timedelta(i) for i in ids]),
                x=pa.array([float(i) for i in ids[:-1]] + [float("nan")]),
                none=pa.array([None] * 10, pa.int32()),
            )
        )
    return names


def files_read(df):
    return len(df.inputFiles())


def test_same_rows_as_a_scan(spark, tmp_path, manifest):
    names = [f"{tmp_path}/{name}" for name in build(spark, str(tmp_path))]
    manifest.take(names)
    for asked in (names, names + names[:1], names[1:]):
        found, wanted = manifest.scan(asked), scan_files(spark, asked)
        assert found.columns == wanted.columns
        assert spark_rows(found) == spark_rows(wanted)
    assert {tuple(r) for r in manifest.counts(names).collect()} == {(names[0], len(RUN1)), (names[1], len(RUN2))}


def test_first_files_columns_by_name(spark, tmp_path, manifest):
    a = put(tmp_path / "a.parquet", k=pa.array([1, 2], pa.int32()), t=pa.array(["x", None]))
    b = put(tmp_path / "b.parquet", more=pa.array([0.5]), T=pa.array([7], pa.int64()), k=pa.array([3], pa.int64()))
    c = put(tmp_path / "c.parquet", k=pa.array([1]))
    manifest.take([a, b, c])
    found = manifest.scan([a, b])
    assert found.schema.simpleString() == "struct<k:int,t:string>"
    assert spark_rows(found) == spark_rows(scan_files(spark, [a, b]))
    with pytest.raises(ValueError, match="lacks"):
        manifest.scan([a, c])


@pytest.mark.parametrize(
    ("ranges", "files"),
    [
        ({"id": (25, 31)}, 2),
        ({"ID": (None, 9)}, 1),
        ({"id": (70, None), "name": (None, "n072")}, 1),
        ({"name": ("n010", "n019")}, 1),
        ({"day": (datetime.date(2020, 1, 15), datetime.date(2020, 1, 25))}, 2),
        ({"x": (75, None)}, 8),
        ({"none": (0, None)}, 8),
        ({"id": (1000, None)}, 0),
        ({}, 8),
    ],
)
def test_files_outside_a_range_are_not_read(spark, numbered, manifest, ranges, files):
    manifest.take(numbered)
    found = manifest.scan(numbered, ranges)
    assert files_read(found) == files
    whole = spark.read.parquet(*numbered)
    for column, (low, high) in ranges.items():
        whole = whole.filter(whole[column].isNotNull())
        whole = whole if low is None else whole.filter(whole[column] >= low)
        whole = whole if high is None else whole.filter(whole[column] <= high)
    assert spark_rows(found) == spark_rows(whole)


def test_text_of_numbers_is_not_pruned_by_its_own_order(spark, tmp_path, manifest):
    a = put(tmp_path / "a.parquet", k=pa.array([5], pa.int64()))
    b = put(tmp_path / "b.parquet", k=pa.array(["10", "9"]))
    manifest.take([a, b])
    assert sorted(r.k for r in manifest.scan([a, b], {"k": (10, None)}).collect()) == [10]


def test_taken_again_and_never(spark, tmp_path, manifest):
    a = put(tmp_path / "a.parquet", k=pa.array([1]))
    with pytest.raises(ValueError, match="not in the manifest"):
        manifest.scan([a])
    manifest.take([a])
    put(tmp_path / "a.parquet", k=pa.array([5, 6]), more=pa.array(["x", "y"]))
    manifest.take([a, a])
    assert [tuple(r) for r in manifest.counts([a]).collect()] == [(a, 2)]
    assert manifest.scan([a], {"k": (6, 6)}).collect() == [(6, "y")]
    with pytest.raises(ValueError, match="no column"):
        manifest.scan([a], {"z": (1, 1)})
    with pytest.raises(Exception, match="FileNotFoundError"):
        manifest.take([f"{tmp_path}/nowhere.parquet"])


def test_uris_and_empty_files(spark, tmp_path, manifest):
    a = put(tmp_path / "a.parquet", k=pa.array([], pa.int64()))
    b = put(tmp_path / "b.parquet", k=pa.array([1]))
    names = [f"file:{a}", f"file://{b}"]
    manifest.take(names)
    assert manifest.scan(names).collect() == [(1,)]
    assert manifest.scan(names, {"k": (1, None)}).collect() == [(1,)]


def test_a_step_reads_by_the_manifest(spark, tmp_path, manifest):
    names = build(spark, str(tmp_path))
    manifest.take([f"{tmp_path}/{name}" for name in names])
    lake = Lake(spark, str(tmp_path), manifest=manifest)
    assert lake.main(names).count() == len(RUN1) + len(RUN2)
    assert lake.main(names).columns == [c.split()[0] for c in CALLS.split(", ")]


def test_as_many_jobs_for_many_files_as_for_one(spark, tmp_path, manifest):
    (tmp_path / "many").mkdir()
    names = [put(tmp_path / "many" / f"{k}.parquet", k=pa.array([k])) for k in range(20 * AT_ONCE)]
    context, jobs = spark.sparkContext, []
    for asked in (names, names[:1], [str(tmp_path / "many")]):
        context.setJobGroup(f"take {len(jobs)}", "take")
        other = Manifest(spark, str(tmp_path / f"manifest {len(jobs)}"))
        try:
            other.take(asked)
        finally:
            context._jsc.clearJobGroup()
        jobs.append(len(context.statusTracker().getJobIdsForGroup(f"take {len(jobs)}")))
        assert other.files().count() == (1 if asked == names[:1] else len(names))
        found = other.scan(asked, {"k": (0, 4)})
        assert files_read(found) == (1 if asked == names[:1] else 5)
        assert sorted(r.k for r in found.collect()) == ([0] if asked == names[:1] else [0, 1, 2, 3, 4])
    assert jobs[0] == jobs[1] == jobs[2]


def test_times(spark, tmp_path, manifest):
    first = datetime.datetime(2020, 1, 1, 0, 0, 0, 1)
    names = [put(tmp_path / f"{k}.parquet", at=pa.array([first + datetime.timedelta(k)], pa.timestamp("us"))) for k in range(3)]
    manifest.take(names)
    found = manifest.scan(names, {"at": (first + datetime.timedelta(1), None)})
    assert files_read(found) == 2
    assert sorted(r["at"] for r in found.collect()) == [first + datetime.timedelta(k) for k in (1, 2)]
    for odd in (0.5, first.replace(tzinfo=datetime.timezone.utc)):
        with pytest.raises(ValueError, match="range"):
            manifest.scan(names, {"at": (odd, None)})


def test_executors_need_not_have_the_package():
    import subprocess
    import sys

    from pyspark import cloudpickle

    from cohortsift.sources import manifest as own

    for task in (own._listed(), own._looked()):
        code = "import sys, pickle; pickle.loads(sys.stdin.buffer.read()); assert not any(m.startswith('cohortsift') for m in sys.modules)"
        subprocess.run([sys.executable, "-c", code], input=cloudpickle.dumps(task), check=True, cwd="/")
