"""Motion-JPEG in AVI: bytes stored without loss, frames read back, shots found.

Bytes are the coefficients of baseline JPEG blocks. A coefficient of size category 8 has 8 further bits, which are the
byte itself: -255 to -128 for bytes below 128, 128 to 255 for others. Tables hold only that category, with the code `0`,
and all quantisers are 1, so the 192 coefficients of one 8 x 8 unit with three components are 192 bytes and take 216 bytes
of scan. A restart marker after every unit keeps the first coefficients free of what went before. Frames are WIDTH x
HEIGHT; the last one is filled up with byte 32, and the length of the payload stands in a chunk of its own.

A reader takes the frames from the index chunk and decodes baseline JPEG of any size, tables, subsampling and restart
interval: Huffman codes to coefficients, these (with the quantisers, by an inverse cosine transform) to samples. Frames of
this module's own tables take a short cut to the same coefficients. Shots: the histogram of a frame's samples against the
frame before; a cut where their difference exceeds the mean of the shot so far by DEVIATIONS standard deviations and
LEAST_CHANGE.

Sizes in RIFF have 32 bits, which is more than a Spark string or binary can hold. Null texts are empty texts. Equal bytes
give equal files and features. Rows are handled one by one; an empty table gives an empty table. A video that can't be read
is a row with its reason, frames that can't be decoded are counted and left out; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import doc_text, slices

UNIT = 192
WIDTH, HEIGHT = 32, 32
UNITS = WIDTH * HEIGHT // 64
RATE = 25
PAD = b" "
DEVIATIONS, LEAST_CHANGE = 3.0, 0.15


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@functools.cache
def header() -> bytes:
    """Everything of a frame before its scan."""
    table = bytes([1] + [0] * 15)  # one code of one bit
    return b"".join([
        b"\xff\xd8",
        segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        segment(0xDB, b"\0" + bytes([1] * 64)),
        segment(0xC0, struct.pack(">BHHB", 8, HEIGHT, WIDTH, 3) + bytes([1, 0x11, 0, 2, 0x11, 0, 3, 0x11, 0])),
        segment(0xC4, b"\x00" + table + b"\x08" + b"\x10" + table + b"\x08"),
        segment(0xDD, struct.pack(">H", 1)),
        segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0])),
    ])


def scans(units: np.ndarray) -> np.ndarray:
    """Rows of 192 bytes -> rows of 216: before each byte the bit 0."""
    bits = np.unpackbits(units, axis=1).reshape(len(units), UNIT, 8)
    return np.packbits(np.concatenate([np.zeros((len(units), UNIT, 1), np.uint8), bits], axis=2).reshape(len(units), -1), axis=1)


def unscanned(rows: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(rows, axis=1).reshape(len(rows), UNIT, 9)
    if bits[:, :, 0].any():
        raise ValueError("a code that the tables do not have")
    return np.packbits(bits[:, :, 1:].reshape(len(rows), -1), axis=1)


def frame(units: np.ndarray) -> bytes:
    """One JPEG picture of UNITS units."""
    parts = [header()]
    for k, row in enumerate(scans(units)):
        parts.append(row.tobytes().replace(b"\xff", b"\xff\0"))
        parts.append(bytes([0xFF, 0xD0 + k % 8]) if k + 1 < len(units) else b"\xff\xd9")
    return b"".join(parts)


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def listed(name: bytes, body: bytes) -> bytes:
    return chunk(b"LIST", name + body)


def write_avi(payload: bytes) -> bytes:
    """payload: a positive multiple of UNIT bytes -> an AVI file with an index."""
    filled = payload + PAD * (-len(payload) % (UNIT * UNITS))
    units = np.frombuffer(filled, np.uint8).reshape(-1, UNITS, UNIT)
    pictures = [chunk(b"00dc", frame(u)) for u in units]
    largest = max(map(len, pictures))
    main = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, len(pictures), 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, RATE, 0, len(pictures), largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 24, b"MJPG", WIDTH * HEIGHT * 3, 0, 0, 0, 0)
    places, at = [], 4
    for p in pictures:
        places.append(struct.pack("<4sIII", b"00dc", 0x10, at, struct.unpack("<I", p[4:8])[0]))
        at += len(p)
    body = listed(b"hdrl", chunk(b"avih", main) + listed(b"strl", chunk(b"strh", stream) + chunk(b"strf", form))) + chunk(b"plen", struct.pack("<Q", len(payload))) + listed(b"movi", b"".join(pictures)) + chunk(b"idx1", b"".join(places))
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def riff_chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, start of the body, its size) of each chunk in a range; a size beyond the range is cut there."""
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        size = min(size, end - start - 8)
        yield name, start + 8, size
        start += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[list[bytes], int, float]:
    """The pictures by the index (or else in file order), the payload's length (-1: not said) and pictures a second."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index, length, rate = None, [], -1, float(RATE)
    for name, at, size in riff_chunks(data, 12, len(data)):
        if name == b"LIST" and data[at : at + 4] == b"movi":
            movi = (at, size)
        elif name == b"LIST" and data[at : at + 4] == b"hdrl":
            for inner, a, _ in riff_chunks(data, at + 4, at + size):
                if inner == b"avih" and (gap := struct.unpack_from("<I", data, a)[0]):
                    rate = 1e6 / gap
        elif name == b"plen":
            length = struct.unpack_from("<Q", data, at)[0]
        elif name == b"idx1":
            index = [struct.unpack_from("<4sIII", data, at + k) for k in range(0, size - size % 16, 16)]
    if movi is None:
        raise ValueError("no pictures")
    if index:
        base = movi[0] if index[0][2] < movi[0] else 0  # offsets count from `movi` or from the file's start
        return [data[base + o + 8 : base + o + 8 + n] for name, _, o, n in index if name[2:] in (b"dc", b"db")], length, rate
    return [data[a : a + n] for name, a, n in riff_chunks(data, movi[0] + 4, movi[0] + movi[1]) if name[2:] in (b"dc", b"db")], length, rate


def _zigzag() -> np.ndarray:
    """For each place along the zigzag its place in rows of 8: diagonals, upwards and downwards in turn."""
    order = sorted(((x + y, x if (x + y) % 2 else y, 8 * x + y) for x in range(8) for y in range(8)), key=lambda t: t[:2])
    return np.array([at for *_, at in order])


@functools.cache
def inverse_transform(quantisers: bytes) -> np.ndarray:
    """The matrix from 64 coefficients along the zigzag to 64 samples in rows, quantisers included."""
    k = np.arange(8)
    cosine = np.cos((2 * k[:, None] + 1) * k[None] * np.pi / 16) * np.where(k == 0, np.sqrt(0.125), 0.5)  # sample, frequency
    whole = np.einsum("yv,xu->vuyx", cosine, cosine).reshape(64, 64)  # place of the coefficient, of the sample
    return (whole[_zigzag()] * np.frombuffer(quantisers, ">u2").astype(float)[:, None]).astype(np.float32)


@dataclass
class Picture:
    """A JPEG's tables and geometry, and its scan."""

    width: int = 0
    height: int = 0
    components: list[tuple[int, int, int, int]] = field(default_factory=list)  # id, horizontal, vertical, quantiser
    quantisers: dict[int, bytes] = field(default_factory=dict)
    codes: dict[int, tuple[list[int], list[int]]] = field(default_factory=dict)  # by class and id: length and symbol by 16 bits
    restart: int = 0
    tables: dict[int, int] = field(default_factory=dict)  # of the scan: component id -> its two tables
    scan: bytes = b""

    def blocks(self) -> list[tuple[int, int]]:
        """Rows and columns of blocks of each component, whole units."""
        high, wide = max(c[2] for c in self.components), max(c[1] for c in self.components)
        down, across = -(-self.height // (8 * high)), -(-self.width // (8 * wide))
        return [(down * v, across * h) for _, h, v, _ in self.components]


def code_table(counts: bytes, symbols: bytes) -> tuple[list[int], list[int]]:
    """For every 16 bits the length (0: none) and the symbol of the code they begin with."""
    length, symbol, code, k = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0
    for size, n in enumerate(counts, 1):
        for s in symbols[k : k + n]:
            at = code << 16 - size
            length[at : at + (1 << 16 - size)], symbol[at : at + (1 << 16 - size)] = size, s
            code += 1
        k, code = k + n, code << 1
    return length.tolist(), symbol.tolist()


def parse_picture(data: bytes) -> Picture:
    """Segments up to and with the scan of a baseline JPEG."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    out, at = Picture(), 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("no scan")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                values = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8)
                out.quantisers[body[0] & 15] = values.astype(">u2").tobytes()
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                out.codes[body[0]] = code_table(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            bits, out.height, out.width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or not out.height or not out.width:
                raise ValueError("not 8 bits a sample, or no size")
            out.components = [(body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]) for k in range(6, 6 + 3 * n, 3)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("not a baseline JPEG")
        elif marker == 0xDD:
            out.restart = struct.unpack(">H", body[:2])[0]
        elif marker == 0xDA:
            out.tables = {body[k]: body[k + 1] for k in range(1, 1 + 2 * body[0], 2)}
            if not out.components or set(out.tables) != {c[0] for c in out.components}:
                raise ValueError("not one scan of all components")
            out.scan = data[at:]
            return out


def intervals(scan: bytes) -> list[bytes]:
    """The bits between restart markers, unstuffed, up to the end of the picture."""
    end = next((m.start() for m in re.finditer(rb"\xff[^\x00\xd0-\xd7\xff]", scan)), len(scan))
    return [part.replace(b"\xff\0", b"\xff") for part in re.split(rb"\xff[\xd0-\xd7]", scan[:end])]


def entropy_decode(data: bytes, blocks: list[tuple[np.ndarray, int, tuple, tuple]]) -> None:
    """Fills blocks (64 coefficients, component, DC codes, AC codes) in order from the bits of one interval."""
    before: dict[int, int] = {}
    bits, have, at, n = 0, 0, 0, len(data)
    for block, component, dc, ac in blocks:
        k, (lengths, symbols) = 0, dc
        while k < 64:
            while have < 32 and at < n + 8:  # the end is filled up with ones
                bits, have, at = (bits << 8 | (data[at] if at < n else 255)) & 0xFFFFFFFFFF, have + 8, at + 1
            first = bits >> have - 16 & 0xFFFF
            size, symbol = lengths[first], symbols[first]
            if not size or have < 32:
                raise ValueError("a code that the tables do not have")
            run, width = (0, symbol) if k == 0 else (symbol >> 4, symbol & 15)
            have -= size
            value = bits >> have - width & (1 << width) - 1 if width else 0
            have -= width
            if width and not value >> width - 1:
                value -= (1 << width) - 1
            if k == 0:
                block[0] = before[component] = before.get(component, 0) + value
                k, (lengths, symbols) = 1, ac
                continue
            if not width and run < 15:
                break
            k += run
            if k > 63:
                raise ValueError("too many coefficients")
            block[k] = value
            k += 1


def decode_coefficients(data: bytes) -> tuple[Picture, list[np.ndarray]]:
    """A picture and for each component its coefficients: rows and columns of blocks, each along the zigzag."""
    if data.startswith(header()):
        return own_picture(), own_coefficients(data)
    picture = parse_picture(data)
    try:
        shapes = picture.blocks()
        out = [np.zeros((*shape, 64), np.int32) for shape in shapes]
        codes = [(picture.codes[picture.tables[c[0]] >> 4], picture.codes[16 + (picture.tables[c[0]] & 15)]) for c in picture.components]
    except (KeyError, ZeroDivisionError, IndexError):
        raise ValueError("a table is missing") from None
    units = []
    if len(out) == 1:  # one component: its blocks one after another, only those that the picture needs
        down, across = -(-picture.height // 8), -(-picture.width // 8)
        units = [[(out[0][y, x], 0, *codes[0])] for y in range(down) for x in range(across)]
    else:
        _, h, v, _ = picture.components[0]
        for y in range(shapes[0][0] // v):
            for x in range(shapes[0][1] // h):
                units.append([(out[i][y * cv + dy, x * ch + dx], i, *codes[i]) for i, (_, ch, cv, _) in enumerate(picture.components) for dy in range(cv) for dx in range(ch)])
    step = picture.restart or len(units)
    parts = intervals(picture.scan)
    if len(parts) < -(-len(units) // step):
        raise ValueError("the picture is cut off")
    for part, k in zip(parts, range(0, len(units), step)):
        entropy_decode(part, [b for unit in units[k : k + step] for b in unit])
    return picture, out


@functools.cache
def own_picture() -> Picture:
    return parse_picture(header())


def own_coefficients(picture: bytes) -> list[np.ndarray]:
    """The short cut for frames of this module: every code is one bit and the byte itself."""
    scan = picture[len(header()) : -2]
    size = UNIT * 9 // 8
    if len(scan) % (size + 2) == size and b"\xff\0" not in scan:  # no byte is stuffed: all units have their place
        rows = np.frombuffer(scan + b"\xff\xd0", np.uint8).reshape(-1, size + 2)[:, :size]
    else:
        rows = np.stack([np.frombuffer(p, np.uint8) for p in intervals(scan + b"\xff\xd9")])
    values = unscanned(np.ascontiguousarray(rows)).astype(np.int32)
    values -= 255 * (values < 128)
    down, across = HEIGHT // 8, WIDTH // 8
    return [values[:, k : k + 64].reshape(down, across, 64) for k in range(0, UNIT, 64)]


def payload_of(coefficients: list[np.ndarray]) -> bytes:
    """The bytes that a frame of this module holds."""
    units = np.concatenate([c.reshape(-1, 64) for c in coefficients], axis=1)
    return (units + 255 * (units < 0)).astype(np.uint8).tobytes()


def block_samples(picture: Picture, coefficients: list[np.ndarray]) -> list[np.ndarray]:
    """Samples (0 to 255) of each component's blocks."""
    out = []
    for (*_, table), own in zip(picture.components, coefficients, strict=True):
        if table not in picture.quantisers:
            raise ValueError("a table is missing")
        values = own.reshape(-1, 64).astype(np.float32) @ inverse_transform(picture.quantisers[table])
        out.append(np.clip(np.rint(values + 128), 0, 255).astype(np.uint8))
    return out


def decode_frame(data: bytes) -> np.ndarray:
    """height x width x components: luminance and, in full size, colour differences."""
    picture, coefficients = decode_coefficients(data)
    wide, high = max(c[1] for c in picture.components), max(c[2] for c in picture.components)
    planes = []
    for (_, h, v, _), own, samples in zip(picture.components, coefficients, block_samples(picture, coefficients), strict=True):
        down, across = own.shape[:2]
        plane = samples.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(8 * down, 8 * across)
        planes.append(plane.repeat(high // v, 0).repeat(wide // h, 1)[: picture.height, : picture.width])
    return np.stack(planes, axis=2)


BINS = 32


def histogram(samples: list[np.ndarray]) -> np.ndarray:
    """Shares of BINS ranges of samples, component by component."""
    return np.concatenate([np.bincount((s >> 3).ravel(), minlength=BINS) / max(1, s.size) for s in samples]) / max(1, len(samples))


def shots(histograms: np.ndarray) -> list[tuple[int, int, float]]:
    """(first frame, frames, change at its start) of each run of alike frames; a row for each frame."""
    n = len(histograms)
    change = np.r_[0.0, np.abs(np.diff(histograms, axis=0)).sum(1) / 2]
    out, start, seen, at_start = [], 0, [], 0.0
    for k in range(1, n):
        c = float(change[k])
        if c > LEAST_CHANGE and (not seen or c > np.mean(seen) + DEVIATIONS * np.std(seen)):
            out.append((start, k - start, at_start))
            start, seen, at_start = k, [], c
        else:
            seen.append(c)
    out.append((start, n - start, at_start))
    return out


def store(text: str) -> tuple[int, bytes, bytes]:
    """Bytes of the text, its payload, and the file that holds it."""
    raw = text.encode()
    payload = raw + PAD * (UNIT if not raw else -len(raw) % UNIT)
    return len(raw), payload, write_avi(payload)


def document_videos(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, media: each text stored as a video."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4_000_000):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([store(t)[2] for t in part.column("text").to_pylist()], pa.binary())], names=["doc_id", "media"])

    return doc_text(docs).mapInArrow(run, "doc_id long, media binary")


def timed_clips(media: bytes) -> tuple[str, list[tuple]]:
    """What is wrong with a video (empty: nothing), and (start_s, end_s, first frame, frames, change, width, height) of its shots; frames count as they stand in the index."""
    try:
        pictures, _, rate = read_avi(media)
    except (ValueError, struct.error) as e:
        return str(e), []
    rows, at, size = [], [], (0, 0)
    for k, data in enumerate(pictures):
        try:
            picture, coefficients = decode_coefficients(data)
            rows.append(histogram(block_samples(picture, coefficients)))
        except (ValueError, struct.error, IndexError):
            continue
        at.append(k)
        size = (picture.width, picture.height)
    if not rows:
        return "no picture can be decoded", []
    width = max(map(len, rows))
    found = shots(np.stack([np.pad(r, (0, width - len(r))) for r in rows]))
    clips = [(at[a] / rate, (at[a + n - 1] + 1) / rate, at[a], n, change, *size) for a, n, change in found]
    return "" if len(at) == len(pictures) else f"{len(pictures) - len(at)} of {len(pictures)} pictures can't be decoded", clips


def clip_rows(videos: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """videos(key, media: AVI files) -> a row for each shot: key, clip, start_s, end_s, first_frame, frames, change, width, height, problem; a video without one has a row with its problem."""
    names = ["clip", "start_s", "end_s", "first_frame", "frames", "change", "width", "height", "problem"]
    types = [pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.string()]
    key_type = videos.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, media, limit=8_000_000):
                rows, owner = [], []
                for i, data in enumerate(part.column(media).to_pylist()):
                    problem, clips = timed_clips(data or b"")
                    own = [(k, *c, problem or None) for k, c in enumerate(clips)] or [(None,) * 8 + (problem,)]
                    rows += own
                    owner += [i] * len(own)
                cols = [part.column(key).take(pa.array(owner, pa.int64()))] + [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays(cols, names=[key, *names])

    return videos.select(key, media).mapInArrow(run, f"`{key}` {key_type}, clip int, start_s double, end_s double, first_frame int, frames int, change double, width int, height int, problem string")


CLIPS = "array<struct<start_s:double,end_s:double,first_frame:int,frames:int,change:double>>"


def media_round_trip(docs: DataFrame, keep: bool = True) -> DataFrame:
    """docs(doc_id, text) -> sizes and hashes of the payload read back and of its file, a feature, the clips, and with keep the file."""
    schema = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips {CLIPS}" + ", media binary" * keep
    clip = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64()), ("first_frame", pa.int32()), ("frames", pa.int32()), ("change", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=4_000_000):
                rows = []
                for text in part.column("text").to_pylist():
                    n, _, media = store(text)
                    pictures, length, rate = read_avi(media)
                    payload, seen = [], []
                    for data in pictures:  # one decoding gives the bytes and the samples
                        picture, coefficients = decode_coefficients(data)
                        payload.append(payload_of(coefficients))
                        seen.append(histogram(block_samples(picture, coefficients)))
                    back = b"".join(payload)[:length]
                    clips = [{"start_s": a / rate, "end_s": (a + k) / rate, "first_frame": a, "frames": k, "change": round(c, 6)} for a, k, c in shots(np.stack(seen))]
                    said = ";".join(f"{c['start_s']:.2f}-{c['end_s']:.2f}:{c['change']:.4f}" for c in clips)
                    rows.append((n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), f"frames={len(pictures)} shots={said}", clips, media))
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip] + [pa.binary()] * keep
                names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"] + ["media"] * keep
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(types))], names=names)

    return doc_text(docs).mapInArrow(run, schema)
