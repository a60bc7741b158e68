"""Schemas of the relations: entries of a tree, chunks of a store, chunk metadata, archive entries."""

ENTRY = "path string, name string, kind string, size long, mode int, owner string, grp string, created timestamp, modified timestamp, target string, resolved string"
CHUNK = "hash string, size long, content binary"
CHUNK_META = "hash string, seq long, size long, content_type string, original_filename string, original_paths array<string>, created long, modified long"
ARCHIVE_ENTRY = "pos long, path string, type string, size long, hash string, target string, special_kind string, mode string, embedded boolean"
ERROR = "struct<stage:string,kind:string,message:string,fatal:boolean>"
