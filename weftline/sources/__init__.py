from .corpus import read_corpus, split_slice, union_shards, write_shards
from .manifest import damaged_files, read_manifest, read_table, union_tables, write_table
from .media import read_media, read_media_parts
from .run_log import append_run_log, read_run_log
from .samples import assemble

__all__ = [
    "append_run_log",
    "assemble",
    "damaged_files",
    "read_corpus",
    "read_manifest",
    "read_media",
    "read_media_parts",
    "read_run_log",
    "read_table",
    "split_slice",
    "union_shards",
    "union_tables",
    "write_shards",
    "write_table",
]
