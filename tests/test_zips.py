"""Archives by member: one is read without the others, large ones in chunks, unpacking is repeatable."""

import zipfile

import pytest
from pyspark.sql import functions as F

from gridloom.sources import zips

NAME = "S2A_MSIL1C_20240101T092401_N0510_R093_T34SEH_20240101T000000"


@pytest.fixture(scope="module")
def archive(tmp_path_factory):
    folder = tmp_path_factory.mktemp("zips")
    with zipfile.ZipFile(folder / f"{NAME}.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(f"{NAME}.SAFE/a.txt", b"alpha")
        z.writestr(f"{NAME}.SAFE/GRANULE/big.bin", bytes(range(256)) * 1000)
        z.writestr(f"{NAME}.SAFE/GRANULE/empty.bin", b"")
        z.mkdir(f"{NAME}.SAFE/folder")
        z.writestr("../out.txt", b"no")
    (folder / "damaged.zip").write_bytes(b"PK nothing")
    return folder


def test_members_and_chunks(spark, archive):
    got = zips.read_zip(spark, str(archive), chunkBytes=100_000).collect()
    by = {}
    for r in got:
        by.setdefault((r["archive"].rsplit("/", 1)[-1], r["member"]), {})[r["chunk"]] = r["content"]
    assert by.pop(("damaged.zip", None)) == {None: None}
    whole = {m.rsplit("/", 1)[-1]: b"".join(bytes(c[k]) for k in sorted(c)) for (_, m), c in by.items()}
    assert whole == {"a.txt": b"alpha", "big.bin": bytes(range(256)) * 1000, "empty.bin": b"", "out.txt": b"no"}
    assert len(by[f"{NAME}.zip", f"{NAME}.SAFE/GRANULE/big.bin"]) == 3 and all(r["size"] == 256_000 for r in got if (r["member"] or "").endswith("big.bin"))


def test_one_member_without_the_others(spark, archive, tmp_path):
    """All other members are spoilt in a copy: a pushed filter never meets them, the whole does."""
    data = bytearray((archive / f"{NAME}.zip").read_bytes())
    with zipfile.ZipFile(archive / f"{NAME}.zip") as z:
        for i in z.infolist():
            if not i.filename.endswith("a.txt") and i.compress_size:
                start = i.header_offset + 30 + len(i.filename)
                data[start : start + i.compress_size] = b"\xff" * i.compress_size
    (tmp_path / "x.zip").write_bytes(bytes(data))
    for pattern in (r"a\.txt$", f"^{NAME}.SAFE/a", "/a[.]"):
        assert [bytes(r["content"]) for r in zips.read_zip(spark, str(tmp_path), members=pattern).collect()] == [b"alpha"]
    d = zips.read_zip(spark, str(tmp_path))
    with pytest.raises(Exception):
        d.collect()
    assert zips.read_zip(spark, str(tmp_path), members="none").count() == 0


def test_filters_of_one_query_do_not_reach_another(spark, archive):
    d = zips.read_zip(spark, str(archive), layout="list")
    few = d.filter(F.col("member").endswith("a.txt"))
    assert (few.count(), d.count(), few.union(d.filter("size = 0")).count()) == (1, 5, 2)


def test_lists_without_content(spark, archive):
    got = {r["member"]: r["size"] for r in zips.read_zip(spark, str(archive), layout="list").collect()}
    assert got == {f"{NAME}.SAFE/a.txt": 5, f"{NAME}.SAFE/GRANULE/big.bin": 256_000, f"{NAME}.SAFE/GRANULE/empty.bin": 0, "../out.txt": 2, None: None}
    assert zips.read_zip(spark, str(archive / "none"), layout="list").count() == zips.read_zip(spark, str(archive / "none")).count() == 0


def test_unpacking(spark, archive, tmp_path):
    """Twice gives the same; a path out of the folder is refused; scenes that are there are left out."""
    for _ in range(2):
        got = {r["member"]: r["file"] for r in zips.unpack(spark, str(archive), str(tmp_path)).collect()}
        assert got.pop("../out.txt") is None and len(got) == 3
        found = sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*") if p.is_file())
        assert found == sorted(f"{NAME}/{m}" for m in got)
    assert (tmp_path / NAME / f"{NAME}.SAFE/GRANULE/big.bin").read_bytes() == bytes(range(256)) * 1000
    here = spark.createDataFrame([(NAME,)], "scene string")
    assert zips.unpack(spark, str(archive), str(tmp_path), present=here).count() == 0
    assert zips.unpack(spark, str(archive), str(tmp_path), pattern=r"\.bin$").count() == 2
