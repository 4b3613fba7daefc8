import os
import struct
import sys
import tempfile
import zlib

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from shelf.session import local_session  # noqa: E402

DATA = os.environ.get("SHELF_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "8g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="shelf-test-")


def png(path, pixels):
    """Write rows of (r, g, b) as a PNG file."""
    h, w = len(pixels), len(pixels[0])
    raw = b"".join(b"\0" + bytes(v for p in row for v in p) for row in pixels)

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    with open(path, "wb") as f:
        f.write(
            b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
        )


@pytest.fixture(scope="session")
def write_png():
    return png
