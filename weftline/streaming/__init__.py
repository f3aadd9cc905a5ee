from .encode import encode_stream
from .packing import pack_stream, stream_tails
from .run import run_to_parquet
from .windows import log_windows

__all__ = ["encode_stream", "log_windows", "pack_stream", "run_to_parquet", "stream_tails"]
