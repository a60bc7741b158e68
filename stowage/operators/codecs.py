"""Decoders of compressed and image content: bytes in, bytes or rows out, errors as data."""

from __future__ import annotations

import io
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gunzip(data: bytes) -> bytes:
    """First member of a gzip stream; the decoder verifies the trailer's checksum, and a stream that ends early raises."""
    stream = zlib.decompressobj(16 + zlib.MAX_WBITS)
    out = stream.decompress(data)
    if not stream.eof:
        raise ValueError("truncated stream")
    return out


def _inflate(data: bytes) -> tuple[bytes, int]:
    """Content of a raw deflate stream and how many bytes it took."""
    stream = zlib.decompressobj(-zlib.MAX_WBITS)
    out = stream.decompress(data)
    if not stream.eof:
        raise ValueError("truncated member")
    return out, len(data) - len(stream.unused_data)


def first_zip_member(data: bytes) -> bytes:
    """Content of the first local member, its checksum verified; shrunk data is decoded here, reduced and imploded is not.

    Where the header leaves sizes to a descriptor after the data, a stored member's come from the central directory.
    """
    at = data.find(b"PK\x03\x04")
    if at < 0:
        raise ValueError("no local file header")
    _, _, flags, method, _, _, crc, packed, size, name, extra = struct.unpack_from("<IHHHHHIIIHH", data, at)
    begin = at + 30 + name + extra
    streamed = bool(flags & 8)
    if streamed and method != 8:
        central = data.find(b"PK\x01\x02", begin)
        if central < 0:
            raise ValueError("truncated archive")
        crc, packed, size = struct.unpack_from("<III", data, central + 16)
    if method not in (0, 1, 8):
        with zipfile.ZipFile(io.BytesIO(data[at:])) as archive:
            return archive.read(archive.infolist()[0])
    if method != 8 and begin + packed > len(data):
        raise ValueError("truncated member")
    if method == 8:
        out, used = _inflate(data[begin:])
        if streamed:
            end = begin + used
            end += 4 * (data[end : end + 4] == b"PK\x07\x08")
            if end + 4 > len(data):
                raise ValueError("truncated member")
            (crc,) = struct.unpack_from("<I", data, end)
    else:
        out = data[begin : begin + packed] if method == 0 else unshrink(data[begin : begin + packed])[:size]
    if zlib.crc32(out) != crc:
        raise ValueError("checksum mismatch")
    return out


def zip_header(data: bytes) -> dict:
    at = data.find(b"PK\x03\x04")
    if at < 0:
        raise ValueError("no local file header")
    _, needed, flags, method, _, _, crc, packed, size, name, _ = struct.unpack_from("<IHHHHHIIIHH", data, at)
    return {"version_needed": needed & 0xFF, "flags": flags, "method": method, "crc": crc, "packed": packed, "size": size, "name": data[at + 30 : at + 30 + name].decode("utf-8", "replace")}


def first_tar_member(data: bytes) -> bytes:
    if len(data) < 512:
        raise ValueError("shorter than a header")
    size = int(data[124:136].strip(b"\0 ") or b"0", 8)
    return data[512 : 512 + size]


def _codes(data: bytes, clear: int, least: int, most: int, lengths) -> Iterator[int]:
    """MSB-first codes whose width ``lengths`` tells."""
    held = bits = at = 0
    width = least
    while True:
        while bits < width:
            if at == len(data):
                return
            held, bits, at = (held << 8 | data[at]) & 0xFFFFFFFF, bits + 8, at + 1
        bits -= width
        yield held >> bits & ((1 << width) - 1)
        width = min(most, lengths())


def lzw(data: bytes, clear: int | None = 256, end: int | None = 257, least: int = 9, most: int = 12) -> bytes:
    """LZW with MSB-first codes of growing width, a clear and an end code."""
    first = max(255, clear or 0, end or 0) + 1
    table: list[bytes] = []
    out, last = bytearray(), b""

    def reset() -> None:
        table[:] = [bytes([k]) for k in range(256)] + [b""] * (first - 256)

    reset()
    for code in _codes(data, clear or 0, least, most, lambda: max(least, (len(table) + (1 if last else 0)).bit_length())):
        if code == end:
            break
        if code == clear:
            reset()
            last = b""
            continue
        if code < len(table) and table[code]:
            word = table[code]
        elif last and code == len(table):
            word = last + last[:1]
        else:
            raise ValueError("code outside the table")
        if last and len(table) < 1 << most:
            table.append(last + word[:1])
        out += word
        last = word
    return bytes(out)


def unshrink(data: bytes) -> bytes:
    """LZW of 9 to 12 bits whose code 256 resets the table."""
    return lzw(data, clear=256, end=None)


def compress_lzw(data: bytes) -> bytes:
    """The inverse of ``lzw`` with the default codes; one clear code at the start."""
    table, codes, word = {bytes([k]): k for k in range(256)}, [(256, 9)], b""
    size, known = 258, 0  # ``known``: entries that the reader has
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in table:
            word = more
            continue
        codes.append((table[word], max(9, (258 + known).bit_length())))
        known = min(known + 1, (1 << 12) - 258)
        if size < 1 << 12:
            table[more] = size
            size += 1
        word = data[k : k + 1]
    if word:
        codes.append((table[word], max(9, (258 + known).bit_length())))
        known = min(known + 1, (1 << 12) - 258)
    codes.append((257, max(9, min(12, (258 + known).bit_length()))))
    out, number, length = bytearray(), 0, 0
    for code, width in codes:
        number, length = number << min(12, width) | code, length + min(12, width)
        while length >= 8:
            length -= 8
            out.append(number >> length)
            number &= (1 << length) - 1
    if length:
        out.append(number << (8 - length))
    return bytes(out)


def iso_entries(data: bytes) -> list[tuple[str, str, int, int]]:
    """(path, kind, offset, length) of an ISO 9660 tree, by the published layout."""
    at = 16 * 2048
    if data[at + 1 : at + 6] != b"CD001" or data[at] != 1:
        raise ValueError("no primary volume descriptor")
    out: list[tuple[str, str, int, int]] = []
    root = data[at + 156 : at + 190]
    waiting, seen = [("", *struct.unpack_from("<I4xI", root, 2))], set()
    while waiting:
        folder, block, length = waiting.pop()
        if block in seen:
            continue
        seen.add(block)
        place, stop = block * 2048, block * 2048 + length
        while place < min(stop, len(data)):
            size = data[place]
            if size == 0:
                place = (place // 2048 + 1) * 2048
                continue
            child, child_length = struct.unpack_from("<I4xI", data, place + 2)
            name = data[place + 33 : place + 33 + data[place + 32]]
            if name not in (b"\0", b"\1"):
                path = f"{folder}/{name.decode('latin-1').split(';')[0]}".lstrip("/")
                is_folder = bool(data[place + 25] & 2)
                out.append((path, "directory" if is_folder else "file", child * 2048, child_length))
                if is_folder:
                    waiting.append((path, child, child_length))
            place += size
    return sorted(out)


DECODERS = {"gzip": gunzip, "zip": first_zip_member, "stuffit": first_zip_member, "tar": first_tar_member, "arc": lzw}


def decompress(files: DataFrame) -> DataFrame:
    """``files`` (path, codec, content) with decoded bytes or an error; unknown codecs pass through unchanged."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, codec, content in zip(batch["path"], batch["codec"], batch["content"], strict=True):
                try:
                    rows.append((path, codec, DECODERS[codec](content) if codec in DECODERS and content is not None else content, None))
                except Exception as e:  # an entry that can't be decoded is a row, not a failed job
                    rows.append((path, codec, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "codec", "content", "error"])

    return files.select("path", "codec", "content").mapInPandas(run, "path string, codec string, content binary, error string")


def _each(read, columns: int):
    """Rows of ``read(content)`` for every file; one that can't be read gives a row with the error alone."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [(path, *r, None) for r in read(content)]
                except Exception as e:  # a bad file is a row, not a failed job
                    rows = [(path, *[None] * columns, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", *[f"c{k}" for k in range(columns)], "error"], dtype=object)

    return run


def _members(content: bytes) -> list[tuple]:
    with tarfile.open(fileobj=io.BytesIO(content)) as archive:
        return [(m.name, m.size, archive.extractfile(m).read()) for m in archive if m.isfile()]


def tar_members(files: DataFrame) -> DataFrame:
    """All members of tar content: (archive, member, size, content, error)."""
    rows = files.select("path", "content").mapInPandas(_each(_members, 3), "path string, c0 string, c1 long, c2 binary, error string")
    return rows.select(F.col("path").alias("archive"), F.col("c0").alias("member"), F.col("c1").alias("size"), F.col("c2").alias("content"), "error")


def iso_tree(images: DataFrame) -> DataFrame:
    """(image, path, kind, offset, length, error) of every entry."""
    rows = images.select("path", "content").mapInPandas(_each(iso_entries, 4), "path string, c0 string, c1 string, c2 long, c3 long, error string")
    return rows.select(F.col("path").alias("image"), F.col("c0").alias("path"), F.col("c1").alias("kind"), F.col("c2").alias("offset"), F.col("c3").alias("length"), "error")


def nested(files: DataFrame) -> DataFrame:
    """Decoded content, decoded a second time where ``nested`` says so: (path, codec, content, nested, error); at most two layers."""
    first = decompress(files).join(files.select("path", "nested"), "path")
    again = decompress(first.where("nested is not null and error is null").select("path", F.col("nested").alias("codec"), "content"))
    second = again.select("path", F.col("content").alias("_content"), F.col("error").alias("_error"), F.lit(True).alias("_again"))
    joined = first.join(second, "path", "left")
    return joined.select("path", "codec", F.when(F.col("_again"), F.col("_content")).otherwise(F.col("content")).alias("content"), "nested", F.coalesce("error", "_error").alias("error"))


def compression_pipeline(files: DataFrame) -> DataFrame:
    """Files (path, content): the codec of each by its extensions (``x.tar.gz`` is a gzip with a tar inside), then both layers."""
    from stowage.functions import paths, types

    low = F.lower(paths.name(F.col("path")))
    outer = types.codec(paths.extension(F.col("path")))
    inner = F.when(low.endswith(".tgz"), "tar").otherwise(types.codec(F.regexp_extract(low, r"\.([^.]+)\.[^.]+$", 1)))
    return nested(files.select("path", "content", F.coalesce(outer, F.lit("none")).alias("codec"), F.when(outer.isNotNull(), inner).alias("nested")))


def tgz_pipeline(files: DataFrame) -> DataFrame:
    """All members of gzipped tars: (archive, member, size, content, error); paths, not positions, keep results apart."""
    unpacked = decompress(files.select("path", F.lit("gzip").alias("codec"), "content"))
    bad = unpacked.where("error is not null").select(F.col("path").alias("archive"), F.lit(None).cast("string").alias("member"), F.lit(None).cast("long").alias("size"), F.lit(None).cast("binary").alias("content"), "error")
    return tar_members(unpacked.where("error is null")).unionByName(bad)


def sectors(images: DataFrame, size: int, heads: int, per_track: int) -> DataFrame:
    """One row a whole sector of ``content``: image, number, track, side, sector and its bytes."""
    from stowage.functions.binary import sector_places

    n = F.floor(F.length("content") / size).cast("int")
    cuts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("number"), F.substring(F.col("content"), k * size + 1, F.lit(size)).alias("data")))
    rows = images.where(n > 0).select("image", F.explode(cuts).alias("s")).select("image", F.col("s.number").alias("number"), F.col("s.data").alias("data"))
    return rows.select("image", F.col("number").cast("long").alias("number"), *[c.alias(k) for k, c in sector_places(F.col("number"), heads, per_track).items()], "data")
