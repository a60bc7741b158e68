"""Codecs, sources, archives, streaming and expressions on small inputs."""

import gzip
import io
import os
import struct
import tarfile
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from stowage import archive
from stowage.functions import binary, hashing, paths, types
from stowage.operators import catalog, codecs, dataflow, images, index, store, tree
from stowage.sources import stores
from stowage.sources.chunkstore import ChunkStore
from stowage.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def test_crc32(spark):
    assert one(spark, hashing.hash_hex(F.col("a"), "CRC32"), a="123456789") == "%08x" % zlib.crc32(b"123456789")


def test_unknown_algorithm():
    with pytest.raises(ValueError):
        hashing.hash_hex(F.lit("x"), "sha9")


def test_gzip_zip_tar():
    data = os.urandom(5000) + b"a" * 5000
    assert codecs.gunzip(gzip.compress(data)) == data
    for method in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", method) as z:
            z.writestr("a.bin", data)
            z.writestr("b.bin", b"other")
        assert codecs.first_zip_member(out.getvalue()) == data
        assert codecs.zip_header(out.getvalue())["name"] == "a.bin"
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        info = tarfile.TarInfo("a")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    assert codecs.first_tar_member(out.getvalue()) == data


@pytest.mark.parametrize("data", [b"", b"a", b"abababababab", b"hello hello hello " * 200, bytes(range(256)) * 30])
def test_lzw_round_trip(data):
    assert codecs.lzw(codecs.compress_lzw(data)) == data


def iso(files):
    """A small image with one folder that holds ``files``."""

    def record(name, block, length, folder):
        body = struct.pack("<BBI", 0, 0, block)[1:] + struct.pack(">I", block) + struct.pack("<I", length) + struct.pack(">I", length) + bytes(7) + bytes([2 if folder else 0, 0, 0]) + bytes(4) + bytes([len(name)]) + name
        size = len(body) + 1 + (len(body) + 1) % 2
        return bytes([size]) + body + bytes(size - len(body) - 1)

    blocks, place, inner = {}, 20, record(b"\0", 19, 2048, True) + record(b"\1", 18, 2048, True)
    for name, data in files.items():
        inner += record(name.encode() + b";1", place, len(data), False)
        blocks[place] = data
        place += -(-len(data) // 2048)
    root = record(b"\0", 18, 2048, True) + record(b"\1", 18, 2048, True) + record(b"DIR", 19, 2048, True)
    image = bytearray(place * 2048)
    image[16 * 2048 : 16 * 2048 + 6] = b"\1CD001"
    image[16 * 2048 + 156 : 16 * 2048 + 190] = record(b"\0", 18, 2048, True)[:34]
    image[18 * 2048 : 18 * 2048 + len(root)] = root
    image[19 * 2048 : 19 * 2048 + len(inner)] = inner
    for at, data in blocks.items():
        image[at * 2048 : at * 2048 + len(data)] = data
    return bytes(image)


def test_iso_tree(spark):
    image = iso({"A.TXT": b"alpha", "B.TXT": b"beta" * 1000})
    frame = spark.createDataFrame([("x.iso", bytearray(image))], "path string, content binary")
    rows = codecs.iso_tree(frame).join(frame.withColumnRenamed("path", "image"), "image")
    got = {r["path"]: (r["kind"], bytes(r["c"] or b"")) for r in rows.select("path", "kind", binary.cut_strict(F.col("content"), F.col("offset"), F.col("length")).alias("c")).collect()}
    assert got["DIR/A.TXT"] == ("file", b"alpha") and got["DIR/B.TXT"] == ("file", b"beta" * 1000) and got["DIR"][0] == "directory"


def test_decompress_errors_are_rows(spark):
    rows = [("a", "gzip", bytearray(gzip.compress(b"x"))), ("b", "gzip", bytearray(b"no")), ("c", "none", bytearray(b"y")), ("d", "zip", None)]
    got = {r["path"]: r for r in codecs.decompress(spark.createDataFrame(rows, "path string, codec string, content binary")).collect()}
    assert bytes(got["a"]["content"]) == b"x" and got["b"]["error"] and bytes(got["c"]["content"]) == b"y" and got["d"]["content"] is None


def test_paths(spark):
    assert one(spark, paths.normalize(F.col("p")), p="\\a//b\\c/") == "a/b/c"
    assert one(spark, paths.resolve(F.lit("a/b"), F.col("p")), p="../c/./d") == "a/c/d"
    assert one(spark, paths.resolve(F.lit("a/b"), F.col("p")), p="/x/../../y") == "y"
    assert one(spark, paths.ignored(F.col("p"), ["!keep.o", "*.o"]), p="keep.o") is False
    assert one(spark, paths.ignored(F.col("p"), ["*.o"]), p="x.org") is True
    assert one(spark, paths.ignored(F.col("p"), ["[*"]), p="x") is False
    assert one(spark, types.parse_octal(F.col("p")), p="0640") == 0o640


def test_validity(spark):
    v = one(spark, store.validity(F.lit("abc"), F.col("h"), F.lit("sha256")), h="zz")
    assert not v["is_valid"] and len(v["errors"]) == 2 and v["warnings"] == ["hash length 2"]


def test_archive_round_trip(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"same")
    (root / "sub/b.txt").write_bytes(b"same")
    (root / "sub/empty").write_bytes(b"")
    (root / "sub/x.o").write_bytes(b"ignored")
    os.symlink("a.txt", root / "link")
    os.mkfifo(root / "pipe")
    chunks = ChunkStore(spark, str(tmp_path / "store"))
    stats = archive.create(spark, str(root), str(tmp_path / "arc"), chunks, special="true")
    assert stats == {"file_count": 3, "directory_count": 1, "unique_hash_count": 2, "total_size": 8}
    assert {(r["path"], r["type"]) for r in archive.contents(spark, str(tmp_path / "arc")).collect()} == {("a.txt", "file"), ("sub", "directory"), ("sub/b.txt", "file"), ("sub/empty", "file"), ("link", "symlink"), ("pipe", "special")}
    assert archive.validate(spark, str(tmp_path / "arc"), chunks)["files_missing"] == 0
    rows = archive.extract(spark, str(tmp_path / "arc"), chunks, str(tmp_path / "out")).collect()
    assert all(r["ok"] for r in rows)
    assert (tmp_path / "out/sub/b.txt").read_bytes() == b"same" and os.readlink(tmp_path / "out/link") == "a.txt"
    other = chunks.delete(chunks.chunks().where("size = 0"), str(tmp_path / "less"))
    assert archive.validate(spark, str(tmp_path / "arc"), other)["files_missing"] == 1
    assert chunks.write(chunks.chunks()) == 0


def test_metadata_merge_is_incremental(spark, tmp_path):
    schema = "hash string, seq long, size long, content_type string, original_filename string, original_paths array<string>, created long, modified long"
    rows = [("h", k, 10 + k, [None, "a", "b"][k % 3], f"f{k}", [f"p{k % 2}"], 5 - k, k) for k in range(4)]
    whole = store.merge_metadata(spark.createDataFrame(rows, schema)).first()
    assert (whole["size"], whole["content_type"], whole["original_filename"], whole["original_paths"], whole["created"], whole["modified"]) == (13, "a", "f0", ["p0", "p1"], 2, 3)
    source = str(tmp_path / "in")
    chunks = ChunkStore(spark, str(tmp_path / "store"))
    for part in (rows[:2], rows[2:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        ingest.upsert_stream(spark, stream, chunks, str(tmp_path / "check")).awaitTermination()
    got = chunks.metadata().first()
    assert all(got[c] == whole[c] for c in ("size", "content_type", "original_filename", "original_paths", "created", "modified"))


def test_pipeline_errors_and_merge(spark):
    base = dataflow.contexts(spark.range(4), "id").withColumn("v", F.lit(None).cast("long"))
    fail = dataflow.stage("s", "v", F.col("id") * 2, F.when(F.col("id") == 2, "two"), fatal=True)
    after = dataflow.stage("t", "v", F.col("v") + 1)
    rows = {r["id"]: r for r in dataflow.Pipeline(fail, after)(base).collect()}
    assert rows[1]["v"] == 3 and rows[2]["v"] is None and [e["message"] for e in rows[2]["errors"]] == ["two"]


def test_tree_and_index(spark):
    entries = spark.createDataFrame([("a/b/c.txt", "file", 3), ("a/d.txt", "file", 4)], "path string, kind string, size long")
    assert {r["folder"]: r["size"] for r in tree.folder_sizes(entries).collect()} == {"": 7, "a": 7, "a/b": 3}
    assert {r["path"] for r in tree.with_ancestors(entries).collect()} == {"a", "a/b", "a/b/c.txt", "a/d.txt"}
    assert tree.navigate(entries, "a/b", "../d.txt").count() == 1 and tree.children(entries, "a").count() == 1
    old = spark.createDataFrame([("h1", 1), ("h2", 2)], "hash string, size long")
    assert {tuple(r) for r in index.upsert(old, spark.createDataFrame([("h2", 9), ("h3", 3)], "hash string, size long")).collect()} == {("h1", 1), ("h2", 9), ("h3", 3)}


def test_binary(spark):
    c = F.col("c")
    value = bytearray(bytes(range(16)))
    assert one(spark, binary.unsigned(c, 0, 4), c=value) == 0x00010203
    assert one(spark, binary.unsigned(c, 0, 4, little=True), c=value) == 0x03020100
    assert one(spark, binary.unsigned(c, 14, 4), c=value) is None
    assert one(spark, binary.matches_magic(c, 1, b"\1\xff\3", [1, 0, 1]), c=value) is True
    assert one(spark, binary.cut(c, 20, 1), c=value) is None
    assert bytes(one(spark, binary.cut(c, 14, 9), c=value)) == b"\x0e\x0f"


# ---- codecs that must not hide damage


def test_truncated_streams_are_errors():
    data = os.urandom(100_000) * 2
    whole = gzip.compress(data)
    with pytest.raises(ValueError):
        codecs.gunzip(whole[: len(whole) // 2])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.bin", data)
    with pytest.raises(ValueError):
        codecs.first_zip_member(out.getvalue()[:50_000])
    broken = bytearray(out.getvalue())
    broken[14] ^= 1  # the checksum
    with pytest.raises(ValueError):
        codecs.first_zip_member(bytes(broken))


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_streamed_zip_members(method):
    class Pipe(io.RawIOBase):
        def __init__(self):
            self.held = bytearray()

        def writable(self):
            return True

        def write(self, b):
            self.held += bytes(b)
            return len(b)

    pipe, data = Pipe(), b"streamed " * 500
    with zipfile.ZipFile(pipe, "w", method) as z, z.open(zipfile.ZipInfo("a"), "w") as member:
        member.write(data)
    assert codecs.first_zip_member(bytes(pipe.held)) == data


def test_lzw_is_linear():
    import time

    data = os.urandom(1000) * 400
    began = time.process_time()
    assert codecs.lzw(codecs.compress_lzw(data)) == data
    assert time.process_time() - began < 10


def test_bad_archives_are_rows(spark):
    rows = spark.createDataFrame([("a", b"no tar at all" * 100), ("b", b"x")], "path string, content binary")
    assert {r["archive"]: r["error"] is not None for r in codecs.tar_members(rows).collect()} == {"a": True, "b": True}
    assert all(r["error"] for r in codecs.iso_tree(rows).collect())


def test_compression_pipelines(spark):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w") as t:
        for name, data in (("a", b"first"), ("b", b"second")):
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    rows = [("x.tar.gz", gzip.compress(out.getvalue())), ("y.tgz", gzip.compress(out.getvalue())), ("z.gz", gzip.compress(b"plain")), ("w.txt", b"as it is"), ("v.gz", b"broken")]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r["path"]: (bytes(r["content"]) if r["content"] is not None else None, r["error"] is not None) for r in codecs.compression_pipeline(files).collect()}
    assert got == {"x.tar.gz": (b"first", False), "y.tgz": (b"first", False), "z.gz": (b"plain", False), "w.txt": (b"as it is", False), "v.gz": (None, True)}
    members = codecs.tgz_pipeline(files.where("path in ('x.tar.gz', 'v.gz')")).collect()
    assert {(r["archive"], r["member"], bytes(r["content"]) if r["content"] is not None else None) for r in members} == {("x.tar.gz", "a", b"first"), ("x.tar.gz", "b", b"second"), ("v.gz", None, None)}


# ---- stores


def test_mirrored_stores(spark, tmp_path):
    first, second = stores.Store(spark, f"{tmp_path}/a"), stores.Store(spark, f"{tmp_path}/b", "flat")
    rows = [(c.encode() * 100,) for c in "abc"]
    files = spark.createDataFrame(rows, "content binary").select(F.sha2("content", 256).alias("hash"), F.length("content").cast("long").alias("size"), "content")
    mirrored = stores.Mirrored(first, second)
    assert first.write(files.where("content = cast(repeat('a', 100) as binary)")) == 1
    assert mirrored.write(files) == [2, 3] and mirrored.write(files) == [0, 0]
    ids = files.select("hash").union(spark.createDataFrame([("f" * 64,)], "hash string"))
    assert sorted(r["found"] for r in mirrored.exists(ids).collect()) == [False, True, True, True]
    assert {bytes(r["content"]) for r in mirrored.read(ids).collect() if r["content"] is not None} == {r[0] for r in rows}
    cut = mirrored.read_range(files.select("hash", F.lit(98).alias("offset"), F.lit(10).alias("length"))).collect()
    assert {bytes(r["content"]) for r in cut} == {b"aa", b"bb", b"cc"}
    only_b = files.where("content = cast(repeat('b', 100) as binary)")
    rest = mirrored.delete(only_b, [f"{tmp_path}/c", f"{tmp_path}/d"])
    assert [r["size"] for r in rest.size(ids.orderBy("hash")).collect() if r["size"] is not None] == [100, 100]
    hashed = files.first()["hash"]
    handle = first.open(hashed)
    assert handle.read(2, 3) == handle.read()[2:5]
    handle.close()
    with pytest.raises(ValueError):
        handle.read()
    with pytest.raises(KeyError):
        first.open("0" * 64)
    assert {r["place"] for r in second.place(files).collect()} == {r["hash"] for r in files.collect()}
    assert stores.Store(spark, f"{tmp_path}/e").write_files(files.select("content")) == 3


def test_hash_cache_saved_and_loaded(spark, tmp_path):
    rows = [(f"p{k}", k, k, f"h{k}", "sha256" if k % 2 else "md5", k) for k in range(10)]
    cache = stores.HashCache(spark.createDataFrame(rows, stores.HashCache.SCHEMA))
    cache.save(f"{tmp_path}/cache")
    loaded = stores.HashCache.load(spark, f"{tmp_path}/cache", most=3)
    assert sorted(r["path"] for r in loaded.rows.collect()) == ["p5", "p7", "p9"]
    fresh = spark.createDataFrame([("p5", 1, 1, "new", 99)], "path string, size long, mtime long, hash string, last_access long")
    assert {r["path"]: r["hash"] for r in loaded.set(fresh).rows.collect()} == {"p5": "new", "p7": "h7", "p9": "h9"}
    assert loaded.remove(fresh.select("path")).rows.count() == 2 and loaded.clear().rows.count() == 0
    assert stores.HashCache.load(spark, f"{tmp_path}/nowhere").rows.count() == 0


def test_broken_versions_do_not_count(spark, tmp_path):
    held = ChunkStore(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([("a", 0, 1, None, None, ["p"], 1, 1)], "hash string, seq long, size long, content_type string, original_filename string, original_paths array<string>, created long, modified long")
    held.merge_metadata(rows)
    os.makedirs(tmp_path / "s" / "metadata-7")
    assert held.metadata().count() == 1


def test_required_location_raises(spark):
    rows = spark.createDataFrame([("a", 1, True, False, True)], "path string, priority int, required boolean, present boolean, writable boolean")
    with pytest.raises(Exception, match="required storage missing"):
        catalog.with_default(rows, "/d").collect()


def test_images_with_errors(spark):
    rows = spark.createDataFrame([("short", b"x"), ("none", None), ("dmg", b"a" * 1024 + b"koly" + b"\xff" * 508)], "image string, content binary")
    for kind in images.FORMATS:
        assert images.read(rows, kind).count() == (0 if kind != "raw" else 0)
    assert {r["image"]: r["error"] for r in images.metadata(rows.where("image = 'dmg'"), "dmg").collect()} == {"dmg": "invalid data"}


def test_wrong_algorithm_is_not_sha256(spark):
    checked = store.validity(F.col("c"), F.md5("c"), F.lit("md5"), ("md5",))
    row = spark.createDataFrame([("abc",)], "c string").select(checked.alias("v")).first()["v"]
    assert row["is_valid"] and row["warnings"] == []


def scanned(root, **options):
    from stowage.sources.fsentries import FsReader

    reader = FsReader({"path": str(root), **options})
    return {r[0]: r[2] for p in reader.partitions() for r in reader.read(p)}


def test_scan_options(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "f").write_text("x")
    (tmp_path / "a" / "up").symlink_to(tmp_path)
    (tmp_path / "to_b").symlink_to(tmp_path / "a" / "b")
    (tmp_path / "gone").symlink_to(tmp_path / "nowhere")
    plain = {"a": "directory", "a/b": "directory", "a/b/f": "file", "a/up": "symlink", "to_b": "symlink", "gone": "symlink"}
    assert scanned(tmp_path) == plain
    (tmp_path / "a" / "b" / "host").symlink_to("/etc/hostname")
    assert "to_b" not in scanned(tmp_path, followlinks="true") and scanned(tmp_path, followlinks="true")["a/b/host"] == "file"
    followed = scanned(tmp_path, followlinks="true", followfolders="true", insideonly="true")
    (tmp_path / "a" / "b" / "host").unlink()
    assert followed == {"a": "directory", "a/b": "directory", "a/b/f": "file", "to_b": "directory", "to_b/f": "file", "gone": "symlink"}
    with pytest.raises(ValueError, match="broken link"):
        scanned(tmp_path, erroronbrokenlinks="true")
    for k in range(20):
        (tmp_path / f"n{k}").mkdir()
    assert scanned(tmp_path) == plain | {f"n{k}": "directory" for k in range(20)}


def test_scan_leaves_out_what_may_not_be_read(tmp_path, monkeypatch):
    (tmp_path / "a").mkdir()
    listed = os.listdir

    def refuse(path):
        if str(path).endswith("/a"):
            raise PermissionError(path)
        return listed(path)

    monkeypatch.setattr(os, "listdir", refuse)
    with pytest.raises(PermissionError):
        scanned(tmp_path)
    assert scanned(tmp_path, skippermissionerrors="true") == {"a": "directory"}
