"""Small catalogue rows."""

import datetime as dt
import random
import struct
import zlib

from mediacat.schema import MEDIA_SCHEMA

DEFAULTS = {
    "folder_id": "f1",
    "media_type": "image",
    "file_size": 1000,
    "taken_at": dt.datetime(2024, 1, 1),
    "modified_time": dt.datetime(2024, 1, 1),
}


def media(spark, *rows):
    """Rows as dicts; what is missing takes the usual default."""
    out = []
    for row in rows:
        full = {**DEFAULTS, "file_hash": f"hash-{row['id']}", "path": f"/lib/{row['id']}.jpg", **row}
        full.setdefault("filename", full["path"].rsplit("/", 1)[-1])
        out.append(tuple(full.get(f.name) for f in MEDIA_SCHEMA))
    return spark.createDataFrame(out, MEDIA_SCHEMA)


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*(columns or df.columns)).collect())


def png(width, height, pixel):
    """An 8-bit RGB PNG; ``pixel(x, y)`` gives the colour."""
    def chunk(kind, data):
        body = kind + data
        return struct.pack(">I", len(data)) + body + struct.pack(">I", zlib.crc32(body))

    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def decode_png(content):
    """(height, width, channels, BGR bytes) of what ``png`` writes; None for anything else."""
    if not content.startswith(b"\x89PNG"):
        return None
    width, height = struct.unpack(">II", content[16:24])
    size = struct.unpack(">I", content[33:37])[0]
    lines = zlib.decompress(content[41 : 41 + size])
    rgb = b"".join(lines[y * (3 * width + 1) + 1 : (y + 1) * (3 * width + 1)] for y in range(height))
    return height, width, 3, b"".join(rgb[i : i + 3][::-1] for i in range(0, len(rgb), 3))


def components_of(pairs):
    """Union-find by hand: {node: least member}."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in list(parent)}


def near_fingerprints(count, seed, spread=6, centres=8):
    """Rows (id, file_size, ph) crowded around a few centres."""
    rng = random.Random(seed)
    bases = [rng.getrandbits(64) for _ in range(centres)]
    rows = []
    for i in range(count):
        bits = bases[0] if rng.random() < 0.4 else rng.choice(bases)
        for p in rng.sample(range(64), rng.randint(0, spread)):
            bits ^= 1 << p
        rows.append((i, rng.choice([0, 900, 1500, 2600, 5300, None]), format(bits, "064b")))
    return rows


def brute_components(rows):
    usable = [(i, s or 0, int(p, 2)) for i, s, p in rows if "1" in p]
    pairs = [
        (a[0], b[0])
        for k, a in enumerate(usable)
        for b in usable[k + 1 :]
        if max(a[1], b[1]) <= 2 * min(a[1], b[1]) and (a[2] ^ b[2]).bit_count() < 10
    ]
    return components_of(pairs)
