"""Volume files written by the test, read by name, by ending and by trial; checks of a manifest."""

import gzip
import zlib

import numpy as np
import pytest

from quarrylake.operators import sampling
from quarrylake.sources import readers as R


def mha(a, compressed=False, big=False):
    kind = {"int16": "MET_SHORT", "float64": "MET_DOUBLE"}[a.dtype.name]
    data = a.astype(a.dtype.newbyteorder(">" if big else "<")).tobytes()
    head = f"ObjectType = Image\nNDims = 3\nBinaryDataByteOrderMSB = {big}\nCompressedData = {compressed}\nOffset = 1 2 3\nElementSpacing = 0.5 0.6 2\nDimSize = {' '.join(map(str, a.shape[::-1]))}\nElementType = {kind}\nElementDataFile = LOCAL\n"
    return head.encode() + (zlib.compress(data) if compressed else data)


def nrrd(a, coding="raw"):
    head = f"NRRD0004\n# a comment\ntype: {a.dtype.name}\ndimension: 3\nsizes: {' '.join(map(str, a.shape[::-1]))}\nendian: little\nencoding: {coding}\nspace directions: (0.5,0,0) (0,0.6,0) (0,0,2)\nspace origin: (1,2,3)\n\n"
    return head.encode() + (gzip.compress(a.tobytes()) if coding == "gzip" else a.tobytes())


def test_volumes(spark, tmp_path):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-99, 99, (2, 3, 4)).astype("int16"), rng.normal(size=(3, 2, 2))
    files = {"a.mha": mha(a), "sub/b.MHA": mha(b, True, True), "c.nrrd": nrrd(a.astype("int16")), "d.nrrd": nrrd(b.astype("float64").astype("float32"), "raw"), "e.nrrd": nrrd(a.astype("uint8"), "gzip"),
             "short.mha": mha(a)[:-3], "text.nrrd": b"no header", "other.raw": b"123"}
    for name, content in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    # numpy's float32 is the header's float
    (tmp_path / "d.nrrd").write_bytes((tmp_path / "d.nrrd").read_bytes().replace(b"type: float32", b"type: float"))
    heads = {r.path.rsplit("/", 1)[-1]: r for r in R.volume_headers(spark, str(tmp_path)).collect()}
    assert set(heads) == {n.rsplit("/", 1)[-1] for n in files}
    assert {n for n, r in heads.items() if r.problem} == {"short.mha", "text.nrrd", "other.raw"}
    assert heads["other.raw"].problem == "no reader for the ending" and heads["a.mha"].reader == "mha"
    for n in ("a.mha", "b.MHA", "c.nrrd", "d.nrrd", "e.nrrd"):
        assert (heads[n].spacing, heads[n].origin) == ([2.0, 0.6, 0.5], [3.0, 2.0, 1.0])
    got = {}
    for r in R.read_volumes(spark, str(tmp_path)).collect():
        got.setdefault(r.path.rsplit("/", 1)[-1], {})[r.z, r.y, r.x] = r.v
    for n, x in {"a.mha": a, "b.MHA": b, "c.nrrd": a, "d.nrrd": b.astype("float32"), "e.nrrd": a.astype("uint8")}.items():
        assert got[n] == {p: float(x[p]) for p in np.ndindex(x.shape)}, n
    assert set(got) == {"a.mha", "b.MHA", "c.nrrd", "d.nrrd", "e.nrrd"}
    own = {"broken": ((".raw",), R.read_mha), "bytes": ((".raw",), lambda c: R.Volume(np.frombuffer(c, "u1").reshape(1, 1, -1), [1.0] * 3, [0.0] * 3))}
    tried = R.volume_headers(spark, str(tmp_path), readers=R.READERS | own).where("reader = 'bytes'").collect()
    assert [r.size for r in tried] == [[1, 1, 3]]
    assert R.volume_headers(spark, str(tmp_path), override="nrrd").where("problem IS NULL").count() == 3
    with pytest.raises(ValueError):
        R.read_volumes(spark, str(tmp_path), override="other")


def test_manifest_checks(spark):
    schema = "case_id string, feature_path string, report_paths array<string>"
    files = spark.createDataFrame([("f",), ("r1",), ("r2",)], "path string")
    good = spark.createDataFrame([("a", "f", ["r1", "r2"]), ("b", "f", ["r2"])], schema)
    assert R.checked_manifest(good, files).count() == 2 and sorted(r.case_id for r in R.checked_manifest(good, files).collect()) == ["a", "b"]
    for row, said in ((("c", "f", []), "no report for case c"), (("c", "g", ["r1"]), "no file g for case c"), (("c", "f", ["r1", "r3"]), "no file r3"), (("c", "f", None), "no report")):
        with pytest.raises(Exception, match=said):
            R.checked_manifest(spark.createDataFrame([row], schema), files).collect()
    with pytest.raises(ValueError):
        R.checked_manifest(good.limit(0), files)


def test_long_series_of_many_chunks(spark):
    n = 30_000
    got = {r.k: r.ema for r in sampling.moving_average(spark.range(n).selectExpr("'a' AS key", "id AS k", "cast(id % 17 AS double) AS v"), "key", "k", "v", 0.5).collect()}
    at = None
    for k in range(n):
        at = float(k % 17) if at is None else 0.5 * at + 0.5 * (k % 17)
        assert got[k] == pytest.approx(at, abs=1e-9)
