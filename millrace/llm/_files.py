"""Files in the shared folder, opened alike by the driver and the executors through pyarrow's filesystems (file, hdfs, s3, gs)."""

from __future__ import annotations


def locate(uri: str):
    """The filesystem of uri and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if ":/" in uri else "file://" + uri)


def make_dir(uri: str) -> None:
    f, path = locate(uri)
    f.create_dir(path, recursive=True)


def write_to(uri: str):
    f, path = locate(uri)
    return f.open_output_stream(path, compression=None)  # else it packs by the name


def random_access(uri: str):
    f, path = locate(uri)
    return f.open_input_file(path)
