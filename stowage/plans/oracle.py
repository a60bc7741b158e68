"""The same queries in SQL, for an independent engine over the same tables."""

from __future__ import annotations

from stowage import dims
from stowage.plans.registry import GREP, IGNORED, TAGS

FILES = """files as (select doc_id as pos, source || '/' || lang || '/' || doc_id || '.txt' as path, cast(strlen(coalesce(text,'')) as bigint) as size,
 sha256(coalesce(text,'')) as hash, 'file' as type, lang, source, coalesce(text,'') as content from documents)"""
HELD = "held as (select hash, min(size) as size from files where pos in (select doc_id from labels) group by hash)"
META = """meta as (select hash, arg_max(size, pos) as size, arg_min(lang, pos) as content_type, arg_min(doc_name, pos) as original_filename,
 array_to_string(list_sort(list_distinct(list(path))), '|') as original_paths, list(path) as paths, min(pos % 1000) as created, max(pos * 7 % 1000) as modified
 from (select *, pos || '.txt' as doc_name from files) group by hash)"""
FOLDERS = """leaves as (select n_name || '/' || c_name || '/' || o_orderkey || '.bin' as path, 'file' as kind, o_orderkey as size, n_name, n_name || '/' || c_name as folder
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey),
 tree as (select path, kind, size from leaves union all select distinct n_name, 'directory', cast(0 as bigint) from leaves union all select distinct folder, 'directory', cast(0 as bigint) from leaves)"""
ORDERS = "o as (select o_orderkey as pos, o_custkey as customer, o_orderpriority as priority, o_orderstatus as status from orders)"
SECTORS = """sectors as (select pos as image, n as number, n // 18 as track, (n // 9) % 2 as side, n % 9 as sector, sha256(array_slice(b, n * 256 + 1, n * 256 + 256)) as data_hash
 from (select pos, encode(content) as b, unnest(range(size // 256)) as n from files where size >= 256))"""
LOCATIONS = """loc as (select s_name as path, case s_suppkey % 4 when 0 then 'secondary' when 1 then 'primary' when 2 then 'glacier' else 'mirror' end as type,
 s_acctbal > 0 as present, s_suppkey % 3 <> 0 as writable from supplier),
 usable as (select path, type, case type when 'primary' then 0 when 'secondary' then 100 when 'glacier' then 200 else 150 end as priority from loc where present and writable)"""
EXTRACT = "x as (select pos, path, case when h.hash is null then 'hash not found: ' || f.hash end as error from files f left join held h using (hash))"
CACHED = """cache as (select path, case when pos % 5 = 0 then size + 1 else size end as size, pos * 1000000 + case when pos % 7 = 0 then 1000000 else 999999 end as mtime, 'cached-' || pos as hash from files where pos % 4 <> 0),
 cached as (select f.path, f.size, f.pos * 1000000 as mtime, coalesce(c.size = f.size and abs(c.mtime - f.pos * 1000000) < 1000000, false) as hit,
 case when coalesce(c.size = f.size and abs(c.mtime - f.pos * 1000000) < 1000000, false) then c.hash else f.hash end as hash from files f left join cache c using (path))"""


def _with(*parts: str) -> str:
    return "with " + ", ".join(parts) + " "


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _pattern(column: str, pattern: str) -> str:
    if pattern.endswith("/"):
        own = pattern[:-1]
        return f"(starts_with({column}, {_text(own + '/')}) or {column} = {_text(own)} or list_contains(string_split({column}, '/'), {_text(own)}))"
    if "*" in pattern or "?" in pattern:
        return f"regexp_matches({column}, {_text(pattern.replace('.', chr(92) + '.').replace('*', '.*').replace('?', '.'))})"
    return f"({column} = {_text(pattern)} or ends_with({column}, {_text('/' + pattern)}))"


def _ignored(column: str, patterns) -> str:
    return "case " + " ".join(f"when {_pattern(column, p.removeprefix('!'))} then {'false' if p.startswith('!') else 'true'}" for p in patterns) + " else false end"


def _case(column: str, table: dict, default: str = "null") -> str:
    value = lambda v: _text(v) if isinstance(v, str) else str(v)
    return f"case {column} " + " ".join(f"when {value(k)} then {value(v)}" for k, v in table.items()) + f" else {default} end"


def _storage(depth: int) -> str:
    return " || ".join(f"substr(hash, {2 * k + 1}, 2) || '/'" for k in range(depth)) + " || hash"


FORMAT = "case when starts_with({0}, 'apple-dos-') then 'dos' || coalesce(nullif(replace(regexp_extract({0}, '3\\.[0-9]+'), '.', ''), ''), '33') when {0} = 'ucsd-pascal' then 'pascal' when {0} = 'apple-ii-cpm' then 'cpm' when {0} = 'iso-9660' then 'iso9660' when {0} in ('2mg', 'twomg') then '2mg' else regexp_replace({0}, 'apple-|apple|-|_', '', 'g') end"


def oracle_sql() -> dict[str, str]:
    groups = {e: g for g, es in dims.TYPE_GROUPS.items() for e in es}
    part_at = lambda column, values: f"case {column} % {len(values)} " + " ".join(f"when {k} then {'null' if v is None else _text(v)}" for k, v in enumerate(values)) + " end"
    extension = part_at("pos", ("dmg", "iso", "img", "vhd", "vmdk", "txt", "zip", "TGZ", "bas"))
    version = "(p_partkey % 4) || case when p_size > 5 then '.' || p_size else '' end || case when p_size % 2 = 0 then '.7' else '' end || case when p_size % 3 = 0 then '-beta' else '' end || case when p_size % 5 = 0 then '+b.1' else '' end"
    return {
        "hash_registry": _with(FILES) + "select hash, max(size) as size, min(pos) as first_pos, count(*) as copies, 'sha256' as algorithm from files group by hash",
        "first_occurrence": _with(FILES) + "select hash, min(pos) as pos, arg_min(path, pos) as path, arg_min(size, pos) as size from files group by hash",
        "archive_stats": _with(FILES) + "select count(*) as file_count, (select count(distinct source) from files) as directory_count, count(distinct hash) filter (where pos % 10 <> 0) as unique_hash_count, cast(sum(size) as bigint) as total_size from files",
        "dedup_report": _with(FILES) + "select cast(sum(size) as bigint) as bytes_before, (select cast(sum(s) as bigint) from (select max(size) as s from files group by hash)) as bytes_after, count(*) as files, count(distinct hash) as chunks from files",
        "hash_hex": _with(FILES) + "select pos, sha256(content) as sha256, sha1(content) as sha1, md5(content) as md5 from files",
        "hash_hex_named": _with(FILES) + "select pos, case when pos % 2 = 0 then sha256(content) else md5(content) end as hash from files",
        "hash_identifier": _with(FILES) + "select pos, 'sha1:' || sha1(content) as identifier from files",
        "meta_merge": _with(FILES, META) + "select * exclude (paths) from meta",
        "validate_archive": _with(FILES, HELD) + "select coalesce(bool_and(h.hash is not null), true) as all_exist, count(*) as total_files, count(h.hash) as files_found, count(*) - count(h.hash) as files_missing, count(distinct f.hash) filter (where h.hash is null) as missing_hashes from files f left join held h using (hash)",
        "join_validate_semi": _with(FILES, HELD) + "select pos, hash from files where hash in (select hash from held)",
        "join_validate_anti": _with(FILES, HELD) + "select pos, hash from files where hash not in (select hash from held)",
        "chunk_exists_batch": _with(FILES, HELD) + "select pos, hash, hash in (select hash from held) as found from files",
        "join_extract": _with(FILES, HELD, EXTRACT) + "select * from x",
        "extract_error_summary": _with(FILES, HELD, EXTRACT) + "select count(error) as error_count, (select string_agg(error, '|' order by error) from (select error from x where error is not null order by error limit 5)) as messages, greatest(count(error) - 5, 0) as more from x",
        "join_mirror_coalesce": _with(FILES) + "select hash, case when pos % 3 = 0 then 0 when pos % 3 <= 1 then 1 else 2 end as store, size from (select hash, min(pos) as pos, min(size) as size from files group by hash) where pos % 3 <= 1 or pos % 2 = 0",
        "join_hash_cache": _with(FILES, CACHED) + "select * from cached",
        "cache_stats": _with(FILES, CACHED) + "select count(*) filter (where hit) as hits, count(*) filter (where not hit) as misses, count(*) filter (where hit) / cast(count(*) as double) as hit_rate from cached",
        "validate_identifier": _with(FILES) + "select pos, pos % 3 <> 1 as is_valid, case when pos % 3 = 1 then 'hash contains non-hex characters' else '' end as errors, case pos % 3 when 0 then 'hash length 40' when 1 then 'hash length 65' else '' end as warnings from files",
        "validate_write": _with(FILES) + "select pos, not (size < 100 and length(content) < 100 or bad) as is_valid, concat_ws('|', case when length(content) < 100 then 'content too small' end, case when bad then 'hash mismatch' end) as errors from (select *, pos % 4 = 0 and reverse(hash) <> hash as bad from files)",
        "storage_path_git": _with(FILES) + "select pos, " + ", ".join(f"{_storage(k)} as depth{k}" for k in (1, 2, 3, 4)) + " from files",
        "path_to_identifier": _with(FILES) + "select pos, case when pos % 2 = 0 then hash end as identifier from files",
        "path_split": f"""select page_id, '/' || trim(path, '/') as normal, array_to_string(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1), '/') as parent, string_split(path, '/')[-1] as name,
 lower(regexp_extract(string_split(path, '/')[-1], '\\.([^.]+)$', 1)) as extension, len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.') and x not in ('.', '..'))) > 0 as hidden,
 {' or '.join(f"contains(path, {_text(p)})" for p in dims.SYSTEM_PARTS)} as system, len(list_filter(string_split(path, '/'), lambda x: x <> '')) as parts
 from (select page_id, regexp_replace(url, '^[a-z]+:/', '') as path from pages)""",
        "tree_navigate": _with(FILES) + "select pos, path as resolved from (select pos, source || '/' || lang || '/' || pos || '.txt' as path from files)",
        "ignore_filter": _with(FILES) + f"select pos, {_ignored('path', IGNORED)} as ignored, " + ", ".join(f"{_pattern('path', p.removeprefix('!'))} as p{k}" for k, p in enumerate(IGNORED)) + " from files",
        "ignore_defaults": f"select page_id, {_ignored('path', dims.IGNORE_DEFAULTS)} as ignored from (select page_id, regexp_replace(url, '^[a-z]+:/', '') as path from pages)",
        "query_by_path": _with(FILES, META) + "select * exclude (paths) from meta where list_contains(paths, 'src1/en/1.txt')",
        "query_by_path_prefix": _with(FILES, META) + "select hash, path from (select hash, unnest(list_distinct(paths)) as path from meta) where starts_with(path, 'src1/')",
        "query_by_size_range": _with(FILES, META) + "select * exclude (paths) from meta where size >= 500 and size < 1500",
        "query_by_content_type": _with(FILES, META) + "select * exclude (paths) from meta where content_type = 'de'",
        "index_build": _with(FILES, META) + "select content_type, count(*) as hashes from meta where content_type is not null group by 1",
        "index_stats": _with(FILES, META) + "select count(*) as entries, count(distinct size) as sizes, count(distinct content_type) as content_types, (select count(distinct path) from files) as paths from meta",
        "search_image_metadata": "select p_partkey || '.img' as filename, p_name as title, p_size as length from part where list_has_any(string_split(p_type, ' '), [" + ", ".join(map(_text, TAGS)) + "]) and p_size between 10 and 40 and contains(lower(p_name), 'red')",
        "topk_main_image": "select p_brand as folder, p_partkey as id, case p_partkey % 5 when 0 then 'iso' when 1 then 'dmg' when 2 then 'img' else 'vhd' end as extension, p_size as size from part where p_partkey % 5 < 4 qualify row_number() over (partition by p_brand order by p_partkey % 5, p_size desc, p_partkey) = 1",
        "folder_size": _with(FOLDERS) + "select folder, cast(sum(size) as bigint) as size, count(*) as files from (select '' as folder, size from leaves union all select n_name, size from leaves union all select folder, size from leaves) group by folder",
        "folder_contents": _with(FOLDERS) + "select folder, count(*) filter (where kind <> 'directory') as files, count(*) filter (where kind = 'directory') as folders from (select regexp_replace(path, '/?[^/]*$', '') as folder, kind from tree) group by folder",
        "scan_tree": _with(FOLDERS) + "select * from tree",
        "tree_traverse": _with(FOLDERS) + "select path, len(string_split(path, '/')) as depth, replace(path, '/', '>') as walk from tree",
        "join_tree_parent": _with(FOLDERS) + "select path, regexp_replace(path, '/?[^/]*$', '') as parent, case when contains(path, '/') then 0 end as parent_size from tree",
        "pipe_flatmap": _with(ORDERS) + "select pos, pos * 2 as double, unnest(string_split(priority, '-')) as part from o where status <> 'F'",
        "pipe_group": _with(ORDERS) + "select priority as group_key, min(pos) as pos, arg_min(customer, pos) as customer, arg_min(status, pos) as status, count(*) as members from o group by priority",
        "pipe_reduce": _with(ORDERS) + "select status, cast(sum(pos) as bigint) as total, min(pos) as first, max(pos) as last from o group by status",
        "pipe_chain_batch": _with(ORDERS) + "select cast(pos as varchar) as input, case when pos % 3 <> 0 then pos * 2 end as a, case when pos % 3 <> 0 then pos * 2 + 1 end as b, case when pos % 3 = 0 then 2 else 1 end - 1 as n_errors from o",
        "result_grep": "with l as (select conv_id, turn, string_split(text, chr(10)) as ls from conversations), e as (select conv_id, turn, ls, unnest(range(len(ls))) as n from l) "
        f"select conv_id, turn, n + 1 as line_number, cast(coalesce(list_sum(list_transform(list_slice(ls, 1, n), lambda x: strlen(x) + 1)), 0) as bigint) as line_offset, ls[n + 1] as line, regexp_extract(ls[n + 1], {_text('(' + GREP + ')')}, 1) as matched from e where regexp_matches(ls[n + 1], {_text(GREP)})",
        "result_listing": _with(FILES) + "select path, type, size, hash from files",
        "listing_totals": _with(FILES) + "select count(*) as files, cast(sum(size) as bigint) as size from files",
        "sector_addressing": _with(FILES, SECTORS) + "select * from sectors",
        "tracks_from_sectors": _with(FILES, SECTORS) + "select image, track, count(*) as sectors, min(number) as first, max(number) as last from sectors group by 1, 2",
        "chunk_read_range": _with(FILES) + "select pos, size, sha256(array_slice(b, 1, 16)) as magic, sha256(array_slice(b, 1, 512)) as header, sha256(array_slice(b, greatest(size - 511, 1), size)) as tail, case when size > 100 then sha256(array_slice(b, 101, 150)) end as range, case when size >= 150 then sha256(array_slice(b, 101, 150)) end as strict from (select *, encode(content) as b from files)",
        "be_u32": _with(FILES) + "select pos, " + "cast('0x' || substr(hash, 1, 8) as bigint) as be32, cast('0x' || substr(hash, 15, 2) || substr(hash, 13, 2) || substr(hash, 11, 2) || substr(hash, 9, 2) as bigint) as le32, cast('0x' || substr(hash, 17, 4) as bigint) as be16, 946684800 + cast('0x' || substr(hash, 1, 8) as bigint) % 1000000 as seconds from files",
        "join_geometry": "select id, sectors, tracks, heads, per_track as sectors_per_track, case when sectors * 128 % 2048 = 0 then 2048 when sectors * 128 % 512 = 0 then 512 when sectors * 128 % 256 = 0 then 256 else 512 end as sector_size, cast(tracks * heads * per_track as bigint) as capacity from (select id, sectors, case when sectors in (720) then 40 when sectors in (1440, 2400, 2880, 5760) then 80 when sectors % 2 = 0 and (sectors // 2) % 40 = 0 then 40 when sectors % 2 = 0 and (sectors // 2) % 80 = 0 then 80 when sectors % 2 = 0 then cast(ceil(sectors / 18) as integer) else cast(ceil(sectors / 9) as integer) end as tracks, case when sectors % 2 = 0 then 2 else 1 end as heads, case when sectors in (720, 1440) then 9 when sectors = 2400 then 15 when sectors = 2880 then 18 when sectors = 5760 then 36 when sectors % 2 = 0 and (sectors // 2) % 40 = 0 then sectors // 80 when sectors % 2 = 0 and (sectors // 2) % 80 = 0 then sectors // 160 else 9 end as per_track from (select p_partkey as id, p_size * 180 as sectors from part))",
        "version_parse": f"select id, case when ok then major end as major, case when ok then minor end as minor, case when ok then patch end as patch, case when ok then suffix end as suffix, case when ok then build end as build, case when ok then concat_ws('.', major, minor, patch) || coalesce('-' || suffix, '') || coalesce('+' || build, '') end as text, case when ok then (major, minor, coalesce(patch, 0)) > (1, 20, 0) end as later from (select id, major, minor, patch, suffix, build, minor is not null as ok from (select p_partkey as id, cast(p_partkey % 4 as integer) as major, case when p_size > 5 then p_size when p_size % 2 = 0 then 7 end as minor, case when p_size > 5 and p_size % 2 = 0 then 7 end as patch, case when p_size % 3 = 0 then 'beta' end as suffix, case when p_size % 5 = 0 then 'b.1' end as build, {version} as source from part))",
        "uti_image": "select id, concat_ws('.', 'com.apple.disk-image', " + FORMAT.format("image") + ", case when system = 'apple-dos-3.3' and starts_with(version, '3.') then 'dos3' || substr(version, 3) when system is not null then " + FORMAT.format("system") + " end, case when system is not null and version is not null then replace(case when starts_with(version, 'v') then '' else 'v' end || version, '-', '.') end) as uti from (select p_partkey as id, " + part_at("p_partkey", ("dmg", "iso-9660", "twomg", "apple-nib", "raw_img")) + " as image, " + part_at("p_partkey", ("apple-dos-3.3", "prodos", "ucsd-pascal", None, "apple-ii-cpm", "fat_16", "apple-dos-x")) + " as system, " + part_at("p_partkey", ("3.2", None, "v2", "1-0")) + " as version from part)",
        "detect_type": _with(FILES) + f"select pos, case when e in ('dmg', 'iso', 'img', 'vhd') then 'disk-image' else 'file' end as type, case when e in ('dmg', 'iso', 'img', 'vhd') then {_case('e', dims.IMAGE_TYPES)} end as content_type, case when {_case('e', dims.IMAGE_TYPES)} is not null then 'disk-image' else 'file' end as by_extension, {_case('lower(e)', groups, _text('unknown'))} as type_group, {_case('lower(e)', dims.CODEC_EXTENSIONS)} as codec from (select pos, {extension} as e from files)",
        "stat_permissions": f"select id, lpad(o, 4, '0') as permissions, m & 4095 as parsed, {_case('m & 61440', dims.DEVICE_KINDS)} as device from (select id, m, ((m & 4095) // 512) || '' || ((m & 511) // 64) || ((m & 63) // 8) || (m & 7) as o from (select p_partkey as id, cast(p_partkey * 37 as integer) as m from part))",
        "available_locations": _with(LOCATIONS) + "select * from usable",
        "mirror_plan": _with(LOCATIONS) + "select path, type, priority, case when path = (select path from usable order by type <> 'primary', priority, path limit 1) then 'primary' when type = 'glacier' then 'glacier' else 'mirror' end as role from usable",
        "embedded_offsets": _with(FILES) + "select pos, cast(1004 + coalesce(sum(76 + size) over (order by pos rows between unbounded preceding and 1 preceding), 0) as bigint) as offset from files",
        "progress_running": _with(FILES) + "select pos, count(*) over w as files_done, cast(sum(size) over w as bigint) as bytes_done from files window w as (order by pos rows unbounded preceding)",
        "lru_order": "select cast(user_id as varchar) as path, max(event_id) as last_access from events group by user_id order by 2 desc, 1 limit 50",
        "decompress_gzip": _with(FILES) + "select path, hash, cast(null as varchar) as error from files",
        "index_upsert": "select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id",
    }
