"""More queries over the driver's tables: images, file types, layouts, configuration, results, each with its SQL beside it.

The SQL states its constants itself. Images are made from the tables' texts, so expected fields are known without decoding.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stowage import dims
from stowage.functions import binary, hashing, paths, types
from stowage.operators import catalog, dataflow, images, store, tree
from stowage.plans.oracle import FILES, FOLDERS
from stowage.plans.registry import files, folders, table
from stowage.sources import stores

ALL: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(run):
        ALL[name] = run
        if sql is not None:
            SQL[name] = sql
        return run

    return keep


def seconds(column):
    return F.unix_timestamp(column).cast("long")


# ---- layouts and paths

H = f"with {FILES}, h as (select pos, path, case when pos % 5 = 0 then substr(hash, 1, 3) else hash end as hash from files) "


def _hashes(s, d):
    return files(s, d).select("pos", "path", F.when(F.col("pos") % 5 == 0, F.substring("hash", 1, 3)).otherwise(F.col("hash")).alias("hash"))


@query("storage_path_snug", H + "select pos, case when length(hash) < 4 then hash else substr(hash, 1, 2) || '/' || substr(hash, 3, 2) || '/' || hash end as place from h")
def _snug(s, d):
    return _hashes(s, d).select("pos", stores.snug_path(F.col("hash")).alias("place"))


@query("storage_path_flat", H + "select pos, hash as place from h")
def _flat(s, d):
    return _hashes(s, d).select("pos", stores.flat_path(F.col("hash")).alias("place"))


@query("is_valid_path", H + "select pos, length(hash) >= 32 as nested, false as flat, length(hash) >= 32 as bare from h")
def _valid_path(s, d):
    deep = F.concat(F.lit("a/"), "hash")
    return _hashes(s, d).select("pos", stores.is_valid_path(deep).alias("nested"), stores.is_valid_path(deep, "flat").alias("flat"), stores.is_valid_path(F.col("hash"), "flat").alias("bare"))


@query("path_relative", f"with {FILES} select pos, case when source = 'src1' then 'root/' || substr(path, 6) end as relative from files")
def _relative(s, d):
    return files(s, d).select("pos", paths.relative(F.col("path"), F.lit("/src1/"), "root").alias("relative"))


@query("ignore_relative", f"with {FILES} select pos, case when source = 'src1' then starts_with(path, 'src1/en/') or regexp_matches(path, '9[.]txt') else path = 'en/' or contains(path, '/en/') or regexp_matches(path, '9[.]txt') end as ignored from files")
def _ignored_below(s, d):
    return files(s, d).select("pos", paths.ignored_below(F.col("path"), F.lit("src1"), ["en/", "*9.txt"]).alias("ignored"))


# ---- chunks


@query("validate_read", f"with {FILES} select pos, pos % 3 <> 0 as is_valid, case when pos % 3 = 0 then 'hash mismatch|content is not what was stored' else '' end as errors, case when pos % 4 = 0 then 'size differs from the metadata' else '' end as warnings from files")
def _validate_read(s, d):
    rows = files(s, d).withColumn("stored", F.when(F.col("pos") % 3 == 0, F.sha2(F.concat("hash", F.lit("x")), 256)).otherwise(F.col("hash")))
    found = store.read_validity(F.col("content").cast("binary"), F.col("stored"), F.lit("sha256"), F.col("size") + F.when(F.col("pos") % 4 == 0, 1).otherwise(0))
    return rows.select("pos", found.alias("v")).select("pos", "v.is_valid", F.array_join("v.errors", "|").alias("errors"), F.array_join("v.warnings", "|").alias("warnings"))


@query("hash_size", f"with {FILES}, n as (select count(distinct hash) as n from files) select algorithm, cast(bytes as int) as bytes, n * bytes / 1048576.0 as overhead_mb from n, (values ('crc32', 4), ('md5', 16), ('sha1', 20), ('sha256', 32)) t(algorithm, bytes)")
def _hash_size(s, d):
    sizes = F.array(*[F.struct(F.lit(k).alias("algorithm"), F.lit(v).alias("bytes")) for k, v in dims.HASH_SIZES.items()])
    n = files(s, d).agg(F.countDistinct("hash").alias("n"))
    return n.select("n", F.explode(sizes).alias("a")).select("a.algorithm", "a.bytes", (F.col("n") * F.col("a.bytes") / 1048576.0).cast("double").alias("overhead_mb"))


@query("image_hash", f"with {FILES} select pos, md5(content) as md5, hash as sha256 from files")
def _image_hash(s, d):
    return files(s, d).select("pos", hashing.hash_hex(F.col("content").cast("binary"), "md5").alias("md5"), hashing.hash_hex(F.col("content").cast("binary")).alias("sha256"))


@query("chunk_read_batch", f"with {FILES}, h as (select hash, min(size) as size from files where pos % 2 = 0 group by hash) select pos, hash, h.size as held from files left join h using (hash)")
def _read_batch(s, d):
    rows = files(s, d)
    return rows.select("pos", "hash").join(rows.where("pos % 2 = 0").groupBy("hash").agg(F.min("size").alias("held")), "hash", "left").select("pos", "hash", "held")


@query("join_embedded_offset", f"with {FILES}, o as (select hash, arg_max(pos * 10, pos) as o from files where pos % 3 <> 0 group by hash) select pos, case when pos % 2 = 0 then o end as \"offset\" from files left join o using (hash)")
def _embedded(s, d):
    rows = files(s, d)
    return store.joined_offsets(rows.select("pos", "hash", (F.col("pos") % 2 == 0).alias("embedded")), rows.where("pos % 3 <> 0").select("hash", "pos", (F.col("pos") * 10).alias("offset"))).select("pos", "offset")


@query("join_index_postings", f"with {FILES}, m as (select hash, min(size) as size from files where pos % 2 = 0 group by hash) select p.lang, p.hash, m.size from (select distinct lang, hash from files) p join m using (hash)")
def _postings(s, d):
    rows = files(s, d)
    return store.join_postings(rows.select("lang", "hash").distinct(), rows.where("pos % 2 = 0").groupBy("hash").agg(F.min("size").alias("size"))).select("lang", "hash", "size")


CACHE = f"""{FILES}, old as (select path, size, pos as mtime, hash, 'sha256' as algorithm, pos % 997 as last_access from files where pos % 2 = 0),
 new as (select path, size + 1 as size, pos as mtime, hash, 'sha256' as algorithm, cast(2000 as bigint) as last_access from files where pos % 3 = 0)"""


def _cache(s, d):
    rows = files(s, d)
    old = rows.where("pos % 2 = 0").select("path", "size", F.col("pos").alias("mtime"), "hash", F.lit("sha256").alias("algorithm"), (F.col("pos") % 997).alias("last_access"))
    new = rows.where("pos % 3 = 0").select("path", (F.col("size") + 1).alias("size"), F.col("pos").alias("mtime"), "hash", F.lit(2000).cast("long").alias("last_access"))
    return stores.HashCache(old, most=1_000_000), new


@query("hash_cache_set", f"with {CACHE} select path, size, mtime, hash, last_access from new union all select path, size, mtime, hash, last_access from old where path not in (select path from new)")
def _cache_set(s, d):
    cache, new = _cache(s, d)
    return cache.set(new).rows.select("path", "size", "mtime", "hash", "last_access")


@query("hash_cache_remove", f"with {CACHE} select path, size from old where path not in (select path from new)")
def _cache_remove(s, d):
    cache, new = _cache(s, d)
    return cache.remove(new).rows.select("path", "size")


# ---- trees

T = f"with {FOLDERS} "


@query("tree_path", T + "select '/vol/' || path as absolute, 'vol' as root from tree")
def _tree_path(s, d):
    return tree.rooted(tree.with_ancestors(folders(s, d)), "vol").select("absolute", "root")


@query("tree_get_file_at", T + "select '/' || n_name || '/' || c_name as folder, cast(o_orderkey as varchar) || '.bin' as name, case when o_orderkey % 2 = 0 then o_orderkey end as size from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey")
def _file_at(s, d):
    rows = folders(s, d)
    asked = rows.select(F.concat(F.lit("/"), paths.parent(F.col("path"))).alias("folder"), paths.name(F.col("path")).alias("name"))
    return tree.file_at(rows.where("size % 2 = 0"), asked).select("folder", "name", "size")


@query("tree_add_child", T + "select path, kind, size from tree union all select 'FRANCE/new.bin', 'file', 7")
def _add_child(s, d):
    return tree.add_child(tree.with_ancestors(folders(s, d)), "/FRANCE", "new.bin", "file", 7)


@query("tree_remove_child", T + "select path, kind, size from tree where path <> 'FRANCE' and not starts_with(path, 'FRANCE/')")
def _remove_child(s, d):
    return tree.remove_child(tree.with_ancestors(folders(s, d)), "FRANCE").select("path", "kind", "size")


@query("count_files", f"with {FILES} select count(*) filter (where not starts_with(path, 'src1/') and not contains(path, '/src1/')) as files from files")
def _count_files(s, d):
    return tree.count_files(files(s, d).select("path", F.lit("file").alias("kind")), ["src1/"])


@query("to_entry_metadata", f"with {FILES} select path, pos || '.txt' as name, 'file' as kind, size, case when pos % 2 = 0 then 'hash=' || hash || ',locked=true' else 'hash=' || hash end as attributes from files")
def _entry_metadata(s, d):
    rows = files(s, d).select("path", F.lit("file").alias("kind"), "size", "hash", (F.col("pos") % 2 == 0).alias("locked"), F.lit(None).cast("string").alias("owner"))
    pairs = F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return tree.entry_metadata(rows).withColumn("attributes", F.array_join(pairs, ","))


@query("to_fs_entry", T + "select path, size from tree where kind <> 'directory'")
def _fs_entry(s, d):
    return tree.fs_entries(tree.with_ancestors(folders(s, d))).select("path", "size")


@query("to_fs_folder", T + "select path from tree where kind = 'directory'")
def _fs_folder(s, d):
    return tree.fs_folders(tree.with_ancestors(folders(s, d))).select("path")


# ---- versions, identifiers, groups

V = "with v as (select p_partkey as pos, case p_partkey % 4 when 0 then p_size || '.' || p_partkey % 7 when 1 then p_size || '.1.2' when 2 then 'v' || p_size else p_name end as t, case p_partkey % 5 when 0 then 'prodos' when 1 then 'apple-dos-3.3' when 2 then 'sos' when 3 then 'ucsd-pascal' else 'fat32' end as fs from part) "


def _versions(s, d):
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(key % 4 == 0, F.concat(size, F.lit("."), (key % 7).cast("string"))).when(key % 4 == 1, F.concat(size, F.lit(".1.2"))).when(key % 4 == 2, F.concat(F.lit("v"), size)).otherwise(F.col("p_name"))
    system = F.element_at(F.array(*map(F.lit, ("prodos", "apple-dos-3.3", "sos", "ucsd-pascal", "fat32"))), (key % 5 + 1).cast("int"))
    return table(s, d, "part").select(key.alias("pos"), text.alias("t"), system.alias("fs"))


@query("version_parse_default", V + "select pos, case pos % 4 when 0 then cast(split_part(t, '.', 1) as int) when 1 then cast(split_part(t, '.', 1) as int) else 9 end as major, case pos % 4 when 0 then cast(split_part(t, '.', 2) as int) when 1 then 1 else 8 end as minor from v")
def _version_default(s, d):
    return _versions(s, d).select("pos", types.version_or(F.col("t"), "9.8").alias("v")).select("pos", "v.major", "v.minor")


@query("filetype_version", V + "select pos, case when pos % 4 < 2 then cast(split_part(t, '.', 1) as int) end as major, case when pos % 4 < 2 then cast(split_part(t, '.', 2) as int) end as minor, case pos % 4 when 0 then 0 when 1 then 2 end as patch, case when pos % 4 < 2 then cast(split_part(t, '.', 1) as int) > 20 end as above from v")
def _type_version(s, d):
    v = types.type_version(F.col("t"))
    return _versions(s, d).select("pos", v["major"].alias("major"), v["minor"].alias("minor"), v["patch"].alias("patch"), (v >= types.type_version(F.lit("21.0"))).alias("above"))


@query("version_display", V + "select pos, case fs when 'prodos' then 'ProDOS ' when 'apple-dos-3.3' then 'DOS ' when 'sos' then 'SOS ' when 'ucsd-pascal' then 'UCSD Pascal ' else '' end || t as os, fs || ' ' || t as app, case when starts_with(t, 'v') then t else 'v' || t end as file from v")
def _version_display(s, d):
    return _versions(s, d).select("pos", types.os_version_display(F.col("fs"), F.col("t")).alias("os"), types.app_version_display(F.col("fs"), F.col("t")).alias("app"), types.file_version_display(F.col("t")).alias("file"))


U = "with u as (select p_partkey as pos, case p_partkey % 4 when 0 then 'Assembly' when 1 then 'text' when 2 then 'binary' end as category, case p_partkey % 3 when 0 then 'prodos' when 1 then 'iso-9660' end as fs, case p_partkey % 5 when 0 then '2-1' when 1 then '' end as ver, p_partkey || case p_partkey % 2 when 0 then '.txt' else '.zip' end as name, case p_partkey % 6 when 0 then 'dmg' end as image from part), w as (select *, case fs when 'prodos' then '.prodos' when 'iso-9660' then '.iso9660' else '' end || case when fs is not null and ver = '2-1' then '.v2.1' else '' end as rest from u) "


def _kinds(s, d):
    key = F.col("p_partkey")
    return table(s, d, "part").select(
        key.alias("pos"), F.when(key % 4 == 0, "Assembly").when(key % 4 == 1, "text").when(key % 4 == 2, "binary").alias("category"), F.when(key % 3 == 0, "prodos").when(key % 3 == 1, "iso-9660").alias("fs"),
        F.when(key % 5 == 0, "2-1").when(key % 5 == 1, "").alias("ver"), F.concat(key.cast("string"), F.when(key % 2 == 0, ".txt").otherwise(".zip")).alias("name"), F.when(key % 6 == 0, "dmg").alias("image"),
    )


@query("uti_file", U + "select pos, 'com.apple.file.' || case category when 'Assembly' then 'binary' when 'text' then 'text' when 'binary' then 'binary' else 'data' end || rest as uti from w")
def _uti_file(s, d):
    return _kinds(s, d).select("pos", types.file_identifier(F.col("category"), F.col("fs"), F.col("ver")).alias("uti"))


@query("uti_entry", U + "select pos, case when image is not null then 'com.apple.disk-image.dmg' || rest else 'com.apple.file.' || case category when 'Assembly' then 'binary' when 'text' then 'text' when 'binary' then 'binary' else case when pos % 2 = 0 then 'text' else 'archive' end end || rest end as uti from w")
def _uti_entry(s, d):
    return _kinds(s, d).select("pos", types.entry_identifier(F.col("name"), F.col("category"), F.col("image"), F.col("fs"), F.col("ver")).alias("uti"))


@query("uti_image_from_metadata", U + "select pos, 'com.apple.disk-image.' || coalesce(image, 'raw') || rest as uti from w")
def _uti_metadata(s, d):
    return _kinds(s, d).select("pos", types.image_identifier(F.coalesce("image", F.lit("raw")), F.col("fs"), F.col("ver")).alias("uti"))


@query("uti_dispatch", U + "select pos, coalesce(image, fs, lower(category), 'none') as provider from w")
def _uti_dispatch(s, d):
    return _kinds(s, d).select("pos", catalog.first_answer(F.col("image"), F.col("fs"), F.lower("category"), F.lit("none")).alias("provider"))


@query("bootability", U + "select pos, case when fs is not null and image is not null then 'bootable' when category = 'text' then 'not-bootable' else 'unknown' end as state from w")
def _bootability(s, d):
    own = F.when(F.col("fs").isNotNull() & F.col("image").isNotNull(), "bootable").otherwise("unknown")
    return _kinds(s, d).select("pos", catalog.bootability(own, F.when(F.col("category") == "text", "not-bootable")).alias("state"))


EXTENSIONS = ("png", "img", "pict", "TXT", "doc", "bas", "dmg", "exe", "zip", "sitx", "mp3", "snd", "mov", "m4v", "rgba", "icns", "dat")


@query("type_group", "select p_partkey as pos, case p_partkey % 17 when 0 then 'image' when 1 then 'image' when 2 then 'image' when 3 then 'text' when 4 then 'text' when 5 then 'basic' when 6 then 'binary' when 7 then 'binary' when 8 then 'archive' when 9 then 'archive' when 10 then 'audio' when 11 then 'audio' when 12 then 'video' when 13 then 'video' when 14 then 'image' when 15 then 'image' else 'unknown' end as type_group, case p_partkey % 3 when 0 then 'binary' when 1 then 'text' else 'unknown' end as of_category from part")
def _type_group(s, d):
    key = F.col("p_partkey")
    category = F.when(key % 3 == 0, "Assembly").when(key % 3 == 1, "document")
    return table(s, d, "part").select(key.alias("pos"), types.type_group(F.element_at(F.array(*map(F.lit, EXTENSIONS)), (key % 17 + 1).cast("int"))).alias("type_group"), types.category_group(category).alias("of_category"))


@query("zip_method_name", "select p_partkey as pos, coalesce(name, 'Unknown') as name, era from part left join (values (0,'Stored',null),(1,'PKZIP Shrinking','1.0'),(2,'PKZIP Reducing (Factor 1)','1.0'),(3,'PKZIP Reducing (Factor 2)','1.0'),(4,'PKZIP Reducing (Factor 3)','1.0'),(5,'PKZIP Reducing (Factor 4)','1.0'),(6,'PKZIP Imploding','1.0'),(8,'Deflate','2.0+'),(9,'Deflate64','2.0+')) m(method, name, era) on method = p_partkey % 11")
def _zip_names(s, d):
    found = types.zip_method(F.col("p_partkey") % 11)
    return table(s, d, "part").select(F.col("p_partkey").alias("pos"), found["name"].alias("name"), found["era"].alias("era"))


@query("zip_metadata", "select p_partkey as pos, case when p_partkey % 3 <> 0 then 20 end as version_needed, case when p_partkey % 3 <> 0 then p_partkey % 2 * 8 end as method, case when p_partkey % 3 <> 0 then case p_partkey % 2 when 0 then 'Stored' else 'Deflate' end end as name, case when p_partkey % 3 <> 0 and p_partkey % 2 = 1 then '2.0+' end as era from part")
def _zip_metadata(s, d):
    key = F.col("p_partkey")
    head = F.concat(F.when(key % 3 == 0, "00000000").otherwise("504B0304"), F.lit("14000000"), F.format_string("%02X00", (key % 2 * 8).cast("int")), F.repeat(F.lit("00"), 40))
    found = types.zip_metadata(F.unhex(head))
    return table(s, d, "part").select(key.alias("pos"), *[found[c].cast("long" if c in ("version_needed", "method") else "string").alias(c) for c in ("version_needed", "method", "name", "era")])


@query("fs_format_dim", "select * from (values ('iso9660',737280000,true,1988,true),('fat32',1073741824,true,1996,true),('ntfs',10737418240,true,1993,true),('exfat',10737418240,true,2006,true)) t(format, capacity, subdirectories, inception, in_use)")
def _file_systems(s, d):
    return catalog.file_systems(s).where("in_use").select("format", "capacity", "subdirectories", "inception", "in_use")


# ---- file types and registries

KINDS = [("com.a.iso", "iso", ["iso", "img"], [(0, b"The ")], "1.0", "disk"), ("com.a.raw", "raw", ["img", "raw"], [(0, b"")], None, "disk"), ("com.a.de", "ger", ["img", "txt"], [(0, b"Der "), (0, b"Die ")], "2.1.0", "text")]
X = f"with {FILES}, x as (select pos, content, case pos % 4 when 0 then 'iso' when 1 then 'img' when 2 then 'txt' else 'none' end as e, starts_with(content, 'The ') as the, starts_with(content, 'Der ') or starts_with(content, 'Die ') as der from files) "


def _typed(s, d):
    extension = F.element_at(F.array(*map(F.lit, (".ISO", "img", "TXT", "none"))), (F.col("pos") % 4 + 1).cast("int"))
    return files(s, d).select(F.col("pos").alias("file"), extension.alias("extension"), F.col("content").cast("binary").alias("content")), catalog.file_types(s, KINDS)


@query("filetype_detect_data", X + "select pos as file, case when the then 'com.a.iso' when der then 'com.a.de' end as type_id from x")
def _detect_data(s, d):
    return catalog.detect_by_data(*_typed(s, d))


@query("filetype_detect_ext_data", X + "select pos as file, case e when 'iso' then 'com.a.iso' when 'img' then case when the then 'com.a.iso' when der then 'com.a.de' else 'com.a.iso' end when 'txt' then 'com.a.de' end as type_id from x")
def _detect_both(s, d):
    return catalog.detect(*_typed(s, d))


@query("filetype_by_ext", X + "select pos as file, unnest(case e when 'iso' then ['com.a.iso'] when 'img' then ['com.a.iso', 'com.a.raw', 'com.a.de'] when 'txt' then ['com.a.de'] else [null] end) as type_id from x")
def _by_extension(s, d):
    return catalog.types_by_extension(*_typed(s, d)).select("file", "type_id")


@query("filetype_by_magic", X + "select pos, the, der from x")
def _by_magic(s, d):
    c = F.col("content").cast("binary")
    return files(s, d).select("pos", binary.matches_magic(c, 0, b"The ").alias("the"), (binary.matches_magic(c, 0, b"Der ") | binary.matches_magic(c, 0, b"Die ")).alias("der"))


@query("filetype_find", "select * from (values ('GER', 'com.a.de'), ('img', 'com.a.iso'), ('img', 'com.a.raw'), ('img', 'com.a.de'), ('com.a.raw', 'com.a.raw')) t(probe, type_id)")
def _find(s, d):
    kinds = catalog.file_types(s, KINDS)
    found = [catalog.find_types(kinds, p).select(F.lit(p).alias("probe"), "type_id") for p in ("GER", "img", "com.a.raw", "nothing")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("filetype_full_id", "select * from (values ('com.a.iso', 'com.a.iso.v1.0'), ('com.a.raw', 'com.a.raw'), ('com.a.de', 'com.a.de.v2.1.0')) t(type_id, full_id)")
def _full_id(s, d):
    return catalog.file_types(s, KINDS).select("type_id", catalog.full_id(F.col("type_id"), F.col("version")).alias("full_id"))


R = "with e as (select 'e' || p_partkey % 200 as extension, max(split_part(p_type, ' ', 1)) as type, max(p_brand) as category from part group by 1) "


def _extensions(s, d):
    return table(s, d, "part").groupBy(F.concat(F.lit("e"), (F.col("p_partkey") % 200).cast("string")).alias("extension")).agg(F.max(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("type"), F.max("p_brand").alias("category"))


@query("registry_sets", R + "select 'type' as kind, type as name, string_agg(extension, ',' order by extension) as extensions from e group by type union all select 'category', category, string_agg(extension, ',' order by extension) from e group by category union all select 'all', '', string_agg(extension, ',' order by extension) from e")
def _sets(s, d):
    return catalog.registry_sets(_extensions(s, d))


@query("ext_registry", R + "select extension, type from e where extension not in ('e1', 'e2', 'e9') union all select 'e1', 'new' union all select 'e2', 'new' union all select 'z', 'new'")
def _register(s, d):
    more = s.createDataFrame([(".E1", "new", "c"), ("e2", "new", "c"), ("z", "new", "c")], "extension string, type string, category string")
    return catalog.unregister(catalog.register(_extensions(s, d), more), [".e9"]).select("extension", "type")


@query("sort_registry", "select p_name as name, p_brand as category, cast(row_number() over (partition by p_brand order by p_name, p_partkey) as bigint) as place from part where list_contains(string_split(p_type, ' '), 'STEEL') and p_brand in (select min(p_brand) from part)")
def _sort_registry(s, d):
    from pyspark.sql import Window

    part = table(s, d, "part")
    rows = part.join(part.agg(F.min("p_brand").alias("p_brand")), "p_brand").select("p_partkey", F.col("p_name").alias("name"), F.col("p_brand").alias("category"), F.split("p_type", " ").alias("tags"))
    place = F.row_number().over(Window.partitionBy("category").orderBy("name", "p_partkey"))
    return catalog.by_name(rows, tag="STEEL").select("name", "category", place.cast("long").alias("place"))


# ---- archive items


@query("archiveorg_detect", "with f as (select p_brand || '.archiveorg' as folder from part where p_partkey % 2 = 0 union select p_brand from part where p_partkey % 2 = 1), g as (select distinct folder, folder || '/deep' as deep from f), i as (select distinct p_brand as b from part where p_partkey % 2 = 1 and p_size % 7 = 0) select folder, ends_with(folder, '.archiveorg') or folder in (select b from i) as is_item from g union all select deep, folder in (select b from i) from g union all select '', (select count(*) > 0 from i)")
def _item_folders(s, d):
    key = F.col("p_partkey")
    folder = F.when(key % 2 == 0, F.concat("p_brand", F.lit(".archiveorg"))).otherwise(F.col("p_brand"))
    extension = F.when((key % 2 == 1) & (F.col("p_size") % 7 == 0), ".ISO").otherwise(".txt")
    return catalog.is_item_folder(table(s, d, "part").select(F.concat(folder, F.lit("/deep/"), key.cast("string"), extension).alias("path")))


@query("archiveorg_metadata", "select s_suppkey as pos, case when s_suppkey % 5 <> 0 then s_name end as identifier, case when s_suppkey % 5 <> 0 and s_suppkey % 3 <> 0 then 'T ' || s_suppkey end as title, case when s_suppkey % 5 <> 0 then 'a|b' || s_suppkey end as collections from supplier")
def _item_metadata(s, d):
    key = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("<?xml version='1.0'?><metadata><identifier> "), "s_name", F.lit(" </identifier><title>"), F.when(F.col("s_suppkey") % 3 == 0, "  ").otherwise(F.concat(F.lit("T "), key)), F.lit("</title><collection>a</collection><collection> b"), key, F.lit("</collection></metadata>"))
    found = catalog.item_metadata(F.when(F.col("s_suppkey") % 5 == 0, "no xml").otherwise(text))
    return table(s, d, "supplier").select(F.col("s_suppkey").alias("pos"), found["identifier"].alias("identifier"), found["title"].alias("title"), F.array_join(found["collections"], "|").alias("collections"))


@query("archiveorg_pick", "with r as (select p_brand as folder, cast(p_partkey as varchar) as path, cast(p_size as bigint) as size, case p_partkey % 5 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 end as rank from part) select folder, arg_min(path, (rank, -size, path)) as path, arg_min(size, (rank, -size, path)) as size from r where rank is not null group by folder")
def _main_images(s, d):
    key = F.col("p_partkey")
    rows = table(s, d, "part").select(F.col("p_brand").alias("folder"), key.cast("string").alias("path"), F.col("p_size").cast("long").alias("size"), F.element_at(F.array(*map(F.lit, ("iso", "dmg", "img", "vhd", "txt"))), (key % 5 + 1).cast("int")).alias("extension"))
    return catalog.main_images(rows)


# ---- storage configuration


@query("storage_speed", "with v as (select s_suppkey as pos, case s_suppkey % 3 when 0 then '/mnt/Dropbox/x' else '/mnt/disk' end as path, s_suppkey % 2 = 0 as network, s_suppkey % 5 = 0 as external, s_suppkey % 7 < 3 as ssd, s_suppkey % 11 = 0 as tb, s_suppkey % 3 = 1 as usb3 from supplier), c as (select pos, case when network then case when path like '%Dropbox%' then 'very-slow' else 'slow' end when external and ssd and tb then 'very-fast' when external and ssd and usb3 then 'fast' when external then 'medium' when ssd then 'very-fast' else 'medium' end as speed from v) select pos, speed, case speed when 'very-fast' then 100 when 'fast' then 80 when 'medium' then 50 when 'slow' then 20 else 10 end as score from c")
def _speed(s, d):
    key = F.col("s_suppkey")
    speed = catalog.storage_speed(F.when(key % 3 == 0, "/mnt/Dropbox/x").otherwise("/mnt/disk"), key % 2 == 0, key % 5 == 0, key % 7 < 3, key % 11 == 0, key % 3 == 1)
    return table(s, d, "supplier").select(key.alias("pos"), speed.alias("speed"), types.lookup(speed, dims.SPEED_SCORES).alias("score"))


def _locations(s, d):
    key = F.col("s_suppkey")
    return table(s, d, "supplier").select(F.col("s_name").alias("path"), F.concat(F.lit("label"), key.cast("string")).alias("label"), (key % 50).alias("priority"), (key % 10 == 3).alias("required"), (key % 4 != 0).alias("present"), (key % 3 != 0).alias("writable"))


L = "with l as (select s_name as path, 'label' || s_suppkey as label, s_suppkey % 50 as priority, s_suppkey % 10 = 3 as required, s_suppkey % 4 <> 0 as present, s_suppkey % 3 <> 0 as writable from supplier), o as (select *, row_number() over (order by priority, path) as place from l), p as (select *, case when not present then 'unavailable' when not writable then 'not writable' end as problem, required or place = 1 as must from o) "


@query("validate_config", L + "select count(*) filter (where problem is not null and must) = 0 as is_valid, string_agg(case when present then 'storage not writable: ' else 'required storage missing: ' end || path, '|' order by place) filter (where problem is not null and must) as issues, string_agg(case when present then 'Storage location ' else 'Optional storage location ' end || problem || ': ' || path, '|' order by place) filter (where problem is not null and not must) as warnings from p")
def _config(s, d):
    found = catalog.validate_config(_locations(s, d), fail_if_unavailable=True)
    return found.select("is_valid", F.nullif(F.array_join("issues", "|"), F.lit("")).alias("issues"), F.nullif(F.array_join("warnings", "|"), F.lit("")).alias("warnings"))


@query("join_config_mirror", L + ", m as (select case s_suppkey % 3 when 0 then s_name when 1 then 'label' || s_suppkey else '/elsewhere/' || s_suppkey end as name, s_suppkey, s_name from supplier) select name, case when s_suppkey % 3 = 2 then name else s_name end as path, s_suppkey % 3 <> 2 as configured from m")
def _mirrors(s, d):
    key = F.col("s_suppkey")
    name = F.when(key % 3 == 0, F.col("s_name")).when(key % 3 == 1, F.concat(F.lit("label"), key.cast("string"))).otherwise(F.concat(F.lit("/elsewhere/"), key.cast("string")))
    return catalog.match_mirrors(table(s, d, "supplier").select(name.alias("name")), _locations(s, d))


@query("available_locations_default", "select '/default' as path, cast(999 as int) as priority")
def _default_location(s, d):
    return catalog.with_default(_locations(s, d).withColumn("priority", F.col("priority").cast("int")).limit(0), "/default")


# ---- results and progress


@query("pipeline_rate_eta", "with o as (select o_orderkey as finished, cast(o_orderkey % 100000 + 1 as double) as seconds from orders), n as (select finished, seconds, row_number() over (order by seconds, finished) as completed from o) select finished, seconds, completed, completed / seconds as rate, (1000000 - completed) / (completed / seconds) as eta from n")
def _rate(s, d):
    done = table(s, d, "orders").select(F.col("o_orderkey").alias("finished"), (F.col("o_orderkey") % 100000 + 1).cast("double").alias("seconds"))
    return stores.rate_and_eta(done, 1000000)


@query("sort_pipeline_results", f"with {FILES} select path, row_number() over (order by path) as place from files")
def _sorted_results(s, d):
    from pyspark.sql import Window

    rows = files(s, d).select("path", "source", F.col("path").alias("input"))
    inside = F.row_number().over(Window.partitionBy("source").orderBy("input"))
    counts = rows.groupBy("source").agg(F.count("*").alias("n"))
    before = counts.select("source", F.coalesce(F.sum("n").over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n0"))
    return rows.join(before, "source").select("path", (F.col("n0") + inside).cast("long").alias("place"))


@query("pipe_batch", f"with {FILES} select path as input, case when pos % 3 <> 0 then size * 2 end as double_size, cast(pos % 3 = 0 as int) as n_errors from files")
def _batch(s, d):
    rows = dataflow.contexts(files(s, d).select("path", "pos", "size"), "path").withColumn("double_size", F.lit(None).cast("long"))
    run = dataflow.stage("double", "double_size", F.col("size") * 2, F.when(F.col("pos") % 3 == 0, "bad input"))
    return dataflow.batch(rows, run, 4).select("input", "double_size", F.size("errors").alias("n_errors"))


@query("result_extract", f"with {FILES} select path, pos % 3 <> 0 as ok, case when pos % 3 <> 0 then size end as bytes, case when pos % 3 = 0 then 'gone' end as error from files")
def _extracted(s, d):
    gone = F.col("pos") % 3 == 0
    return dataflow.extract_result(files(s, d).select("path", F.when(~gone, F.col("content").cast("binary")).alias("content"), F.when(gone, "gone").alias("error")))


@query("result_metadata", f"with {FILES} select path, lang as content_type, size, hash from files")
def _result_metadata(s, d):
    return dataflow.metadata_result(files(s, d).withColumn("content_type", F.col("lang")))


# ---- disk images, made of text and a trailer

DMG_BODY = "rpad(p_name || '|', cast(512 * (3 + p_size % 5) as int), '.')"


def _padded(column, size, fill="."):
    return F.rpad(column, size, fill).cast("binary")


def _dmg(s, d):
    key, n = F.col("p_partkey"), 3 + F.col("p_size") % 5
    body = F.concat(F.lit("ab" * 8), F.rpad(F.concat("p_name", F.lit("|")), (512 * n).cast("int"), "."))
    u32 = lambda c: F.format_string("%08X", c.cast("int"))
    u64 = lambda c: F.format_string("%016X", c.cast("long"))
    zero = lambda n: F.lit("00" * n)
    trailer = F.concat(F.lit("6B6F6C79"), u32(F.lit(4)), u32(F.lit(512)), u32(key), u64(F.lit(0)), u64(F.lit(16)), u64(512 * n), u64(F.lit(0)), u64(F.lit(0)), zero(144), u64(F.lit(7)), u64(key), zero(208), u64(n * 40), zero(80))
    return table(s, d, "part").select(key.alias("image"), F.concat(body.cast("binary"), F.unhex(trailer)).alias("content"))


@query("udif_trailer", "select p_partkey as image, 4 as version, 512 as header_size, p_partkey as flags, 16 as data_offset, 512 * (3 + p_size % 5) as data_length, 7 as xml_offset, p_partkey as xml_length, 40 * (3 + p_size % 5) as sector_count from part")
def _udif(s, d):
    found = images.udif_trailer(F.col("content"))
    names = ("version", "header_size", "flags", "data_offset", "data_length", "xml_offset", "xml_length", "sector_count")
    return _dmg(s, d).select("image", *[found[n].cast("long").alias(n) for n in names])


@query("image_metadata_dmg", "select p_partkey as image, cast(greatest(1, 40 * (3 + p_size % 5) // 63) as bigint) as tracks, cast(1 as bigint) as sides, cast(63 as bigint) as per_track, cast(3 + p_size % 5 as bigint) as sectors from part")
def _dmg_metadata(s, d):
    return images.metadata(_dmg(s, d), "dmg").select("image", "tracks", "sides", "per_track", "sectors")


@query("image_read_dmg", f"with b as (select p_partkey as image, {DMG_BODY} as body, unnest(range(cast(3 + p_size % 5 as bigint))) as number from part) select image, number, cast(0 as bigint) as track, number as sector, sha256(substr(body, cast(number * 512 + 1 as bigint), 512)) as data from b")
def _dmg_sectors(s, d):
    return images.read(_dmg(s, d), "dmg").select("image", "number", "track", "sector", F.sha2("data", 256).alias("data"))


@query("geometry_dmg", "select p_partkey as pos, cast(greatest(1, p_partkey * 100 // 63) as bigint) as tracks, cast(63 as bigint) as per_track from part")
def _dmg_geometry(s, d):
    g = images.geometry_dmg(F.col("p_partkey") * 100)
    return table(s, d, "part").select(F.col("p_partkey").alias("pos"), g["tracks"].alias("tracks"), g["per_track"].alias("per_track"))


def _vhd(s, d):
    key = F.col("s_suppkey")
    footer = F.concat(F.lit("636F6E6563746978"), F.lit("00" * 16), F.format_string("%08X", (key * 1000).cast("int")), F.lit("00" * 28), F.format_string("%04X0203", (key % 9 + 1).cast("int")), F.lit("00000002"), F.lit("00" * 448))
    return table(s, d, "supplier").select(key.alias("image"), F.concat(_padded(F.col("s_name"), 512 * 30), F.unhex(footer)).alias("content"))


@query("vhd_footer", "select s_suppkey as image, s_suppkey % 9 + 1 as cylinders, 2 as heads, 3 as sectors_per_track, 2 as disk_type, 946684800 + s_suppkey * 1000 as created from supplier")
def _footer(s, d):
    found = images.vhd_footer(F.col("content"))
    return _vhd(s, d).select("image", *[found[n].cast("long").alias(n) for n in ("cylinders", "heads", "sectors_per_track", "disk_type")], seconds(found["created"]).alias("created"))


@query("image_metadata_vhd", "select s_suppkey as image, 946684800 + s_suppkey * 1000 as image_date, s_suppkey % 9 + 1 as tracks, cast(2 as bigint) as sides, cast(3 as bigint) as per_track, least(30, 6 * (s_suppkey % 9 + 1)) as sectors from supplier")
def _vhd_metadata(s, d):
    return images.metadata(_vhd(s, d), "vhd").select("image", seconds("image_date").alias("image_date"), "tracks", "sides", "per_track", "sectors")


@query("image_read_vhd", "with b as (select s_suppkey as image, rpad(s_name, 15360, '.') as body, unnest(range(least(30, 6 * (s_suppkey % 9 + 1)))) as number from supplier) select image, number, number // 6 as track, number // 3 % 2 as side, number % 3 as sector, sha256(substr(body, cast(number * 512 + 1 as bigint), 512)) as data from b")
def _vhd_sectors(s, d):
    return images.read(_vhd(s, d), "vhd").select("image", "number", "track", "side", "sector", F.sha2("data", 256).alias("data"))


@query("vhd_timestamp", "select p_partkey as pos, 946684800 + p_partkey * 86400 as created from part")
def _timestamp(s, d):
    return table(s, d, "part").select(F.col("p_partkey").alias("pos"), seconds(images.vhd_timestamp(F.col("p_partkey") * 86400)).alias("created"))


def _iso(s, d):
    key = F.col("n_nationkey")
    date = F.concat(F.format_string("19%02d", (key + 60).cast("int")), F.lit("0203040506"), F.lit("00"))
    head = F.concat(F.lit("\x01CD001\x01\x00"), F.rpad(F.lit(""), 32, " "), F.rpad("n_name", 32, " "), F.rpad(F.lit(""), 8, " "))
    body = F.concat(_padded(F.col("n_name"), 32768), head.cast("binary"), F.unhex(F.concat(F.format_string("%02X000000", key.cast("int")), F.lit("00" * 729))), F.rpad(date, 17, "0").cast("binary"), F.unhex(F.lit("00" * 1218)), _padded(F.concat(F.lit("file of "), "n_name"), 2048))
    return table(s, d, "nation").select(key.alias("image"), F.when(key % 5 == 0, _padded(F.col("n_name"), 40000)).otherwise(body).alias("content"))


@query("iso_pvd_fields", "select n_nationkey as image, case when n_nationkey % 5 <> 0 then n_name end as volume_id, case when n_nationkey % 5 <> 0 then n_nationkey end as blocks, case when n_nationkey % 5 <> 0 then cast(epoch(make_timestamp(1960 + n_nationkey, 2, 3, 4, 5, 6.0)) as bigint) end as created from nation")
def _pvd(s, d):
    found = images.iso_pvd_fields(F.col("content"))
    return _iso(s, d).select("image", found["volume_id"].alias("volume_id"), found["blocks"].cast("long").alias("blocks"), seconds(found["created"]).alias("created"))


@query("image_metadata_iso", "select n_nationkey as image, case when n_nationkey % 5 <> 0 then n_name else 'Hybrid Disc' end as title, case when n_nationkey % 5 <> 0 then cast(18 as bigint) else cast(19 as bigint) end as per_track from nation")
def _iso_metadata(s, d):
    return images.metadata(_iso(s, d), "iso").select("image", "title", "per_track")


@query("image_read_iso", "with b as (select n_nationkey as image, rpad(n_name, 32768, '.') as body, unnest(range(16)) as number from nation) select image, number, cast(0 as bigint) as track, number as sector, sha256(substr(body, cast(number * 2048 + 1 as bigint), 2048)) as data from b")
def _iso_sectors(s, d):
    return images.read(_iso(s, d), "iso").where("number < 16").select("image", "number", "track", "sector", F.sha2("data", 256).alias("data"))


@query("iso_read_file", "select n_nationkey as image, 'F' as path, case when n_nationkey % 5 <> 0 then rpad('file of ' || n_name, 60, '.') else repeat('.', 60) end as data from nation")
def _iso_file(s, d):
    made = _iso(s, d)
    entries = made.select("image", F.lit("F").alias("path"), F.lit(34816).alias("offset"), F.lit(60).alias("length"))
    return images.entry_read(entries, made).select("image", "path", F.col("data").cast("string").alias("data"))


@query("entry_read", "select n_nationkey as image, case when n_nationkey % 2 = 0 then 'in' else 'out' end as path, case when n_nationkey % 2 = 0 then rpad(n_name, 20, '.') end as data, case when n_nationkey % 2 = 1 then 'invalid data' end as error from nation")
def _entry_read(s, d):
    made, key = _iso(s, d), F.col("image")
    entries = made.select("image", F.when(key % 2 == 0, "in").otherwise("out").alias("path"), F.when(key % 2 == 0, 0).otherwise(50000).alias("offset"), F.lit(20).alias("length"))
    return images.entry_read(entries, made).select("image", "path", F.col("data").cast("string").alias("data"), "error")


@query("iso_dec_datetime", "select p_partkey as pos, case when p_partkey % 3 <> 0 then cast(epoch(make_timestamp(1950 + p_size, 1 + p_size % 12, 3, 4, 5, 6.0)) as bigint) end as t from part")
def _dec_date(s, d):
    text = F.when(F.col("p_partkey") % 3 == 0, "no date at all...").otherwise(F.format_string("%04d%02d0304050600", (F.col("p_size") + 1950).cast("int"), (F.col("p_size") % 12 + 1).cast("int")))
    return table(s, d, "part").select(F.col("p_partkey").alias("pos"), seconds(images.iso_volume_date(text)).alias("t"))


@query("iso_rec_datetime", "select p_partkey as pos, case when p_partkey % 3 <> 0 then cast(epoch(make_timestamp(1950 + p_size, 1 + p_size % 12, 3, 4, 5, 6.0)) as bigint) end as t from part")
def _rec_date(s, d):
    text = F.format_string("%02X%02X0304050600", (F.col("p_size") + 50).cast("int"), F.when(F.col("p_partkey") % 3 == 0, 99).otherwise(F.col("p_size") % 12 + 1).cast("int"))
    return table(s, d, "part").select(F.col("p_partkey").alias("pos"), seconds(images.iso_record_date(F.unhex(text))).alias("t"))


FLOPPIES = (368640, 737280, 1228800, 1474560)


def _floppy(s, d):
    size = F.element_at(F.array(*map(F.lit, FLOPPIES)), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(s, d, "nation").select(F.col("n_nationkey").alias("image"), F.rpad("n_name", size, ".").cast("binary").alias("content"))


I = "with b as (select n_nationkey as image, n_name, case n_nationkey % 4 when 0 then 720 when 1 then 1440 when 2 then 2400 else 2880 end as n, case n_nationkey % 4 when 0 then 40 else 80 end as tracks, case n_nationkey % 4 when 0 then 9 when 1 then 9 when 2 then 15 else 18 end as spt from nation) "


@query("image_metadata_img", I + "select image, cast(tracks as bigint) as tracks, cast(2 as bigint) as sides, cast(spt as bigint) as per_track, cast(n as bigint) as sectors from b")
def _img_metadata(s, d):
    return images.metadata(_floppy(s, d), "img").select("image", "tracks", "sides", "per_track", "sectors")


@query("image_read_img", I + ", c as (select *, unnest(range(n)) as number from b) select image, number, number // (2 * spt) as track, number // spt % 2 as side, number % spt as sector, sha256(case when number = 0 then rpad(n_name, 512, '.') else repeat('.', 512) end) as data from c")
def _img_sectors(s, d):
    return images.read(_floppy(s, d), "img").select("image", "number", "track", "side", "sector", F.sha2("data", 256).alias("data"))


@query("image_write_img", I + "select image, n * 512 as size, sha256(rpad(n_name, n * 512, '.')) as hash from b")
def _img_write(s, d):
    made = images.write(images.read(_floppy(s, d), "img"), 512)
    return made.select("image", F.length("content").alias("size"), F.sha2("content", 256).alias("hash"))


@query("image_write_raw", I + "select image, n * 512 as size, sha256(rpad(n_name, n * 512, '.')) as hash from b")
def _raw_write(s, d):
    made = images.write(images.read(_floppy(s, d), "img"))
    return made.select("image", F.length("content").alias("size"), F.sha2("content", 256).alias("hash"))


@query("sort_sectors", I + ", c as (select image, n, tracks, spt, unnest(range(n)) as number from b) select image, number, cast(row_number() over (partition by image order by number // (2 * spt), number // spt % 2, number % spt) as bigint) as place from c")
def _sort_sectors(s, d):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("image").orderBy("track", "side", "sector"))
    return images.read(_floppy(s, d), "img").select("image", "number", place.cast("long").alias("place"))


@query("geometry_img", "select p_partkey as pos, case when n = 720 then 40 when n = 1440 then 80 when n = 2880 then 80 else 0 end as tracks, case when n = 720 then 9 when n = 1440 then 9 when n = 2880 then 18 else 0 end as per_track from (select p_partkey, case p_partkey % 3 when 0 then 720 when 1 then 1440 else 2880 end as n from part)")
def _img_geometry(s, d):
    n = F.when(F.col("p_partkey") % 3 == 0, 720).when(F.col("p_partkey") % 3 == 1, 1440).otherwise(2880)
    g = images.geometry_img(n * 512)
    return table(s, d, "part").select(F.col("p_partkey").alias("pos"), g["tracks"].cast("int").alias("tracks"), g["per_track"].cast("int").alias("per_track"))


def _raw(s, d):
    size = F.element_at(F.array(F.lit(65536), F.lit(66048), F.lit(65792), F.lit(65537)), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return table(s, d, "nation").select(F.col("n_nationkey").alias("image"), F.rpad("n_name", size, ".").cast("binary").alias("content"))


W = "with b as (select n_nationkey as image, n_name, case n_nationkey % 4 when 0 then 2048 when 1 then 512 when 2 then 256 else 512 end as sector, case n_nationkey % 4 when 0 then 32 when 1 then 129 when 2 then 257 else 128 end as n from nation) "


@query("image_metadata_raw", W + "select image, cast(sector as bigint) as sector_size, cast(80 as bigint) as tracks, cast(18 as bigint) as per_track, cast(n as bigint) as sectors from b")
def _raw_metadata(s, d):
    return images.metadata(_raw(s, d), "raw").select("image", "sector_size", "tracks", "per_track", "sectors")


@query("image_read_raw", W + ", c as (select *, unnest(range(n)) as number from b) select image, number, number // 18 as track, number % 18 as sector, sha256(case when number = 0 then rpad(n_name, sector, '.') else repeat('.', sector) end) as data from c")
def _raw_sectors(s, d):
    return images.read(_raw(s, d), "raw").select("image", "number", "track", "sector", F.sha2("data", 256).alias("data"))


@query("geometry_raw", "with r as (select p_partkey as pos, p_partkey * 1000 * 512 as size from part), t as (select pos, size, case when size % 2048 = 0 then 2048 else 512 end as sector from r) select pos, sector as sector_size, case when size // sector <= 2880 then 80 else greatest(1, size // sector // 63) end as tracks, case when size // sector <= 2880 then 18 else 63 end as per_track from t")
def _raw_geometry(s, d):
    g = images.geometry_raw(F.col("p_partkey") * 1000 * 512)
    return table(s, d, "part").select(F.col("p_partkey").alias("pos"), g["sector_size"].cast("int").alias("sector_size"), g["tracks"].alias("tracks"), g["per_track"].cast("int").alias("per_track"))


@query("geometry_capacity", "select p_partkey as pos, case when p_partkey % 3 = 0 then 143360 else cast(p_size as bigint) * 2 * 9 * 512 end as bytes from part")
def _capacity(s, d):
    tracks = F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("long"))
    return table(s, d, "part").select(F.col("p_partkey").alias("pos"), images.capacity(tracks, F.lit(2), F.lit(9), F.lit(512)).alias("bytes"))


@query("sector_flags", "select p_partkey as pos, p_partkey % 2 = 1 as deleted, p_partkey // 2 % 2 = 1 as weak, p_partkey // 4 % 2 = 1 as damaged from part")
def _flags(s, d):
    found = images.sector_flags(F.col("p_partkey"))
    return table(s, d, "part").select(F.col("p_partkey").alias("pos"), *[c.alias(k) for k, c in found.items()])


@query("be_u64", f"with {FILES} select pos, cast(('0x' || substr(hash, 1, 16))::ubigint as varchar) as be64 from files")
def _u64(s, d):
    return files(s, d).select("pos", binary.unsigned_64(F.unhex("hash"), 0).cast("string").alias("be64"))


def queries() -> dict:
    return dict(ALL)


SQL["can_read"] = f"""with {FILES}, b as (select pos, encode(content) as b, octet_length(encode(content)) as n from files)
 select pos, n >= 512 and array_slice(b, n - 511, n - 508) = 'koly'::blob as dmg, n >= 34816 and array_slice(b, 32770, 32774) = 'CD001'::blob as iso,
 n >= 512 and array_slice(b, n - 511, n - 504) = 'conectix'::blob as vhd, n between 368640 and 10485760 and n % 512 = 0 as img, n between 65536 and 10737418240 as raw from b"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
