"""Files of other formats than Spark's in the shared folder."""

from __future__ import annotations

from pyarrow import fs

#: Schemes that Hadoop names otherwise than Arrow does.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system of a URI, and the path there. Local paths, file, hdfs, s3 (also as s3a), gs and abfss are known."""
    scheme, colon, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}{colon}{rest}")
