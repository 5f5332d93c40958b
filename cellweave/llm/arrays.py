"""Arrays in files of the shared folder, written by tasks and memory-mapped by workers.

A file tells what is in it: eight bytes with the length of a header, the header (JSON), the arrays.  A worker keeps the files
it used last open, a bounded number of them; what a store that can't be mapped holds is copied to nameless local files, and
kept up to a bounded number of bytes.
"""

from __future__ import annotations

import json
import os
import resource
import tempfile
import uuid
from collections import OrderedDict
from urllib.parse import unquote, urlparse

import numpy as np

#: Files that a worker keeps open (each has a descriptor, so half of those allowed at most), and bytes of local copies.
OPEN_FILES, COPIED_BYTES = min(4096, resource.getrlimit(resource.RLIMIT_NOFILE)[0] // 2), 1 << 30

_open: OrderedDict[str, tuple[dict[str, np.ndarray] | None, int]] = OrderedDict()


def _local(uri: str) -> str | None:
    """The path that the folder is mounted at, for file: and plain paths."""
    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return unquote(parsed.path)
    return None


def make_folder(uri: str) -> None:
    if path := _local(uri):
        os.makedirs(path, exist_ok=True)
    else:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(uri)
        fs.create_dir(path)


def save(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes the arrays into one file, under another name first, so that a task run again does no harm."""
    layout, at = [], 0
    for name, a in arrays.items():
        layout.append((name, a.dtype.str, at, len(a)))
        at += -(-a.nbytes // 8) * 8
    header = json.dumps(layout).encode()
    header += b" " * (-len(header) % 8)
    draft = f"{uri}.{uuid.uuid4().hex}"
    local = _local(uri)
    if local:
        out = open(_local(draft), "wb")
    else:
        from pyarrow.fs import FileSystem

        fs, path = FileSystem.from_uri(draft)
        out = fs.open_output_stream(path)
    with out:
        out.write(len(header).to_bytes(8, "little") + header)
        for a in arrays.values():
            out.write(np.ascontiguousarray(a).tobytes() + b"\0" * (-a.nbytes % 8))
    if local:
        os.replace(_local(draft), local)
    else:
        fs.move(path, FileSystem.from_uri(uri)[1])


def _mapped(uri: str) -> tuple[np.ndarray | None, int]:
    """(the file's bytes, or none if there is no such file; how many were copied)."""
    if path := _local(uri):
        return (np.memmap(path, np.uint8, "r"), 0) if os.path.exists(path) else (None, 0)
    from pyarrow.fs import FileSystem, FileType

    fs, path = FileSystem.from_uri(uri)
    if fs.get_file_info(path).type == FileType.NotFound:
        return None, 0
    copy = tempfile.TemporaryFile()
    with fs.open_input_stream(path) as source:
        while part := source.read(1 << 24):
            copy.write(part)
    copy.flush()
    return np.memmap(copy, np.uint8, "r"), copy.tell()


def load(uri: str) -> dict[str, np.ndarray] | None:
    """The arrays, memory-mapped; none if there is no such file."""
    if uri in _open:
        _open.move_to_end(uri)
        return _open[uri][0]
    data, copied = _mapped(uri)
    arrays = None
    if data is not None:
        n = int.from_bytes(data[:8].tobytes(), "little")
        arrays = {name: np.ndarray(size, np.dtype(kind), data, 8 + n + at) for name, kind, at, size in json.loads(data[8 : 8 + n].tobytes())}
    _open[uri] = (arrays, copied)
    while len(_open) > 1 and (len(_open) > OPEN_FILES or sum(x[1] for x in _open.values()) > COPIED_BYTES):
        _open.popitem(last=False)  # closed when the last of its arrays goes
    return arrays
