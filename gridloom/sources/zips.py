"""Zip archives by member.

``gridloom_zip`` reads an archive's central directory alone when it plans, and
members are its partitions: ``spark.read.format("gridloom_zip").load(path)`` after
:func:`register` gives (archive, member, size, chunk, content) of one archive or of
all below a folder.  The option ``members``, a regular expression, chooses members: one
is read without the others.  A member larger than a chunk is several rows, so no
cell grows with it.  ``option("layout", "list")`` gives (archive, member, size,
packed) and reads no content.  A damaged archive is one row without a member.
"""

from __future__ import annotations

import re
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridloom.sources.storage import files, ship, store

SCHEMA = "archive string, member string, size long, chunk int, content binary"
LIST_SCHEMA = "archive string, member string, size long, packed long"


class ZipSource(DataSource):
    """Options: path, members, layout (content or list), chunkBytes (of a row), groupBytes (of a partition of small members)."""

    @classmethod
    def name(cls):
        return "gridloom_zip"

    def schema(self):
        return LIST_SCHEMA if self.options.get("layout") == "list" else SCHEMA

    def reader(self, schema):
        return ZipReader(self.options)


def _members(archive: str):
    """[(name, size, packed size)] of an archive's files, from its central directory; None where it is damaged."""
    at, inner = store(archive)
    try:
        with at.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
            return [(i.filename, i.file_size, i.compress_size) for i in z.infolist() if not i.is_dir()]
    except (zipfile.BadZipFile, EOFError, ValueError):
        return None


class ZipReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.list = options["path"], options.get("layout") == "list"
        self.chunk, self.group = int(options.get("chunkBytes", 8_000_000)), int(options.get("groupBytes", 64_000_000))
        self.members = re.compile(options.get("members") or "")

    def _wanted(self, name: str) -> bool:
        return bool(self.members.search(name))

    def partitions(self):
        from concurrent.futures import ThreadPoolExecutor

        archives = files(self.path, (".zip",))
        if self.list:
            return [InputPartition(archives[k : k + 16]) for k in range(0, max(1, len(archives)), 16)]

        def plan(archive):
            found = _members(archive)
            if found is None:
                return [InputPartition((archive, [None]))]
            parts, some, held = [], [], 0
            for name, size, _ in found:
                if not self._wanted(name):
                    continue
                some.append(name)
                held += size
                if held >= self.group:
                    parts.append(InputPartition((archive, some)))
                    some, held = [], 0
            return parts + ([InputPartition((archive, some))] if some else [])

        with ThreadPoolExecutor(16) as pool:
            parts = [p for some in pool.map(plan, archives) for p in some]
        return parts or [InputPartition(("", []))]

    def read(self, partition):
        if self.list:
            for archive in partition.value:
                found = _members(archive)
                for name, size, packed in [(None, None, None)] if found is None else found:
                    if name is None or self._wanted(name):
                        yield archive, name, size, packed
            return
        archive, names = partition.value
        if names == [None]:
            yield archive, None, None, None, None
            return
        if not names:
            return
        at, inner = store(archive)
        with at.open_input_file(inner) as f, zipfile.ZipFile(f) as z:
            for name in names:
                size = z.getinfo(name).file_size
                with z.open(name) as m:
                    k, data = 0, m.read(self.chunk)
                    while data or k == 0:
                        yield archive, name, size, k, data
                        k, data = k + 1, m.read(self.chunk)


def register(spark: SparkSession) -> None:
    ship(spark)
    spark.dataSource.register(ZipSource)


def read_zip(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("gridloom_zip").options(**options).load(path)


def unpack(spark: SparkSession, path: str, folder: str, *, pattern: str | None = None, present: DataFrame | None = None) -> DataFrame:
    """Write the members of the archives at ``path`` below ``folder``; (archive, member, size, file) of what is there then.

    ``pattern`` (a regular expression) chooses members; archives whose product is
    in ``present`` (scene) already are left out.  Members go to
    ``folder/<archive name>/<member>``, streamed to a name of their own and moved, so
    that a repeated attempt replaces and never mixes.  Members whose path would
    leave the folder are refused (file is null); damaged archives give no row.
    """
    from gridloom.sources.scenes import scene_of

    found = read_zip(spark, path, layout="list", members=pattern or "").filter("member is not null")
    if present is not None:
        found = found.withColumn("scene", scene_of(F.col("archive"))).join(present.select("scene").distinct(), "scene", "left_anti")

    def write(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for archive, member, size in zip(*[b.column(c).to_pylist() for c in ("archive", "member", "size")]):
                parts = member.replace("\\", "/").split("/")
                if ".." in parts or member.startswith("/"):
                    out.append((archive, member, size, None))
                    continue
                name = archive.rsplit("/", 1)[-1].removesuffix(".zip")
                target = f"{folder.rstrip('/')}/{name}/{'/'.join(parts)}"
                at, inner = store(target)
                at.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                aside = f"{inner.rsplit('/', 1)[0]}/_{uuid.uuid4().hex}"
                source, place = store(archive)
                with source.open_input_file(place) as f, zipfile.ZipFile(f) as z, z.open(member) as m, at.open_output_stream(aside) as o:
                    while data := m.read(8_000_000):
                        o.write(data)
                at.move(aside, inner)
                out.append((archive, member, size, target))
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["archive", "member", "size", "file"])

    from gridloom.operators.graph import _cut

    # one task for some 64 MB of members: they are dealt by number in order of size
    n = found.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    dealt = found.select("archive", "member", "size").repartition(max(1, min(10_000, n // 64_000_000 + 1)), "archive", "member")
    kernel = lambda batches: (w for b in batches if b.num_rows for w in write([b]))
    return _cut(dealt.mapInArrow(kernel, "archive string, member string, size long, file string"))
