"""Lossless motion-JPEG in AVI, vectorised over the lines of many files.

A frame is a lossless JPEG image (ITU-T T.81, SOF3: 8-bit samples, one component, predictor 1)
of 64 samples a line with a restart after each line, so a line's entropy-coded bytes decode on
their own and all lines decode in step. The RIFF file has the usual header lists, a movi list
of 00dc chunks, and an idx1 index. A strd chunk has the number of samples, as the last frame is
filled up with zeros.

The reader goes by each frame's own markers: its Huffman table, size and restart interval. Other
kinds of JPEG (baseline, several components, other predictors, restarts that are not lines) are
refused with ValueError, never decoded to something else.
"""

import functools
import struct
from dataclasses import dataclass

import numpy as np

WIDTH, MAX_HEIGHT, FRAME_MICROSECONDS = 64, 64, 40_000

#: Code lengths and codes of the difference categories 0 to 8 in the Huffman table.
CODE_LENGTH = np.array([4, 4, 3, 3, 3, 3, 3, 3, 4])
CODE = np.array([0b1100, 0b1101, 0b000, 0b001, 0b010, 0b011, 0b100, 0b101, 0b1110])


def _encoder() -> tuple[np.ndarray, np.ndarray]:
    """By difference + 255: code with its extra bits, and length."""
    code, length = np.zeros(511, np.uint32), np.zeros(511, np.int64)
    for d in range(-255, 256):
        category = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << category) - 1
        code[d + 255], length[d + 255] = int(CODE[category]) << category | extra, int(CODE_LENGTH[category]) + category
    return code, length


_CODE, _LENGTH = _encoder()
#: Bits that a code and its extra bits may have together; lines that are coded at once.
LOOK_BITS, LINES_AT_ONCE = 16, 1 << 15


@dataclass(frozen=True)
class FrameFormat:
    """What a frame's markers say: size, where coded data begins, and by the next ``LOOK_BITS``
    bits a difference and the bits that it takes (0: no code)."""

    width: int
    height: int
    begin: int
    difference: np.ndarray
    taken: np.ndarray


@functools.lru_cache(maxsize=256)
def _decoder(table: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The look-up of a Huffman table: counts of codes by length, then categories."""
    difference, taken = np.zeros(1 << LOOK_BITS, np.int32), np.zeros(1 << LOOK_BITS, np.int32)
    code, at = 0, 16
    for n in range(1, 17):
        for category in table[at : at + table[n - 1]]:
            bits = n + category
            if bits > LOOK_BITS:
                raise ValueError("a JPEG table with longer codes than are supported")
            for extra in range(1 << category):
                value = extra if not category or extra >> category - 1 else extra - (1 << category) + 1
                place = (code << category | extra) << LOOK_BITS - bits
                difference[place : place + (1 << LOOK_BITS - bits)] = value
                taken[place : place + (1 << LOOK_BITS - bits)] = bits
            code += 1
        at += table[n - 1]
        code <<= 1
    return difference, taken


@functools.lru_cache(maxsize=4096)
def _format(header: bytes) -> FrameFormat:
    """The format that a frame's bytes up to its coded data describe."""
    table = size = interval = None
    at = 2
    while at + 4 <= len(header):
        mark, length = header[at + 1], struct.unpack_from(">H", header, at + 2)[0]
        body = header[at + 4 : at + 2 + length]
        if header[at] != 0xFF:
            raise ValueError("a JPEG frame with a broken marker")
        if mark == 0xC4:
            if table or len(body) < 17 or body[0] != 0 or len(body) != 17 + sum(body[1:17]):
                raise ValueError("a JPEG frame with other Huffman tables than one")
            table = body[1:]
        elif mark == 0xC3:
            precision, height, width, components = struct.unpack_from(">BHHB", body)
            if (precision, components) != (8, 1):
                raise ValueError("a JPEG frame of other samples than 8-bit grey")
            size = width, height
        elif 0xC0 <= mark <= 0xCF and mark != 0xCC:
            raise ValueError("a JPEG frame that isn't lossless")
        elif mark == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif mark == 0xDA and (body[0], body[3], body[5]) != (1, 1, 0):
            raise ValueError("a JPEG scan with another predictor")
        at += 2 + length
    if not table or not size or interval != size[0]:
        raise ValueError("a JPEG frame whose restarts are not its lines")
    return FrameFormat(*size, len(header), *_decoder(table))


@functools.cache
def _frame_header(height: int) -> bytes:
    by_length = [int((CODE_LENGTH == n).sum()) for n in range(1, 17)]
    symbols = [int(i) for n in range(1, 17) for i in np.flatnonzero(CODE_LENGTH == n)]
    huffman = struct.pack(">HB16B", 19 + len(symbols), 0, *by_length) + bytes(symbols)
    return (
        b"\xff\xd8\xff\xc4" + huffman
        + b"\xff\xc3" + struct.pack(">HBHHBBBB", 11, 8, height, WIDTH, 1, 1, 0x11, 0)
        + b"\xff\xdd" + struct.pack(">HH", 4, WIDTH)
        + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0, 1, 0, 0)
    )


def _coded_lines(lines: np.ndarray, last: np.ndarray, number: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Entropy-coded bytes of the lines, a marker behind each; and the ends of lines in them."""
    before = np.concatenate([np.full((len(lines), 1), 128, np.uint8), lines[:, :-1]], axis=1)
    difference = lines.astype(np.int16) - before + 255
    length = _LENGTH[difference]
    in_line = np.cumsum(length, axis=1)
    sizes = (in_line[:, -1] + 7) // 8
    starts = np.cumsum(sizes) - sizes
    bit = (in_line - length + 8 * starts[:, None]).ravel()
    word = _CODE[difference].ravel() << (24 - length.ravel() - (bit & 7)).astype(np.uint32)
    at, total = bit >> 3, int(sizes.sum())
    raw = np.zeros(total + 2, np.int64)
    for i, shift in enumerate((16, 8, 0)):
        raw += np.bincount(at + i, weights=(word >> np.uint32(shift)) & np.uint32(255), minlength=total + 2)[: total + 2].astype(np.int64)
    raw = raw[:total].astype(np.uint8)
    ends = starts + sizes
    spare = (8 * sizes - in_line[:, -1]).astype(np.uint8)
    raw[ends - 1] |= ((1 << spare.astype(np.int64)) - 1).astype(np.uint8)  # padded with ones
    full = raw == 255
    stuffed = np.cumsum(full)
    line_of = np.repeat(np.arange(len(lines)), sizes)
    place = np.arange(total) + stuffed - full + 2 * line_of
    out_ends = ends + stuffed[ends - 1] + 2 * np.arange(1, len(lines) + 1)
    out = np.zeros(int(out_ends[-1]), np.uint8)
    out[place] = raw
    out[out_ends - 2] = 255
    out[out_ends - 1] = np.where(last, 0xD9, 0xD0 + number % 8)
    return out.tobytes(), out_ends


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)


def _avi(frames: list[bytes], height: int, samples: int) -> bytes:
    largest = max(map(len, frames))
    avih = struct.pack("<14I", FRAME_MICROSECONDS, 0, 0, 0x10, len(frames), 0, 1, largest, WIDTH, height, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack(
        "<IHHIIIIIIIIHHHH", 0, 0, 0, 0, FRAME_MICROSECONDS, 1_000_000, 0, len(frames), largest, 0, 0, 0, 0, WIDTH, height
    )
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, height, 1, 8, b"MJPG", WIDTH * height, 0, 0, 0, 0)
    strl = b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", samples))
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", strl))
    parts, index, at = [b"movi"], [], 4
    for f in frames:
        parts.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(parts)) + _chunk(b"idx1", b"".join(index)))


def _frames(lines: np.ndarray, heights: list[int]) -> list[bytes]:
    """Coded frames of these heights over the lines."""
    number = np.concatenate([np.arange(h) for h in heights])
    coded, ends = _coded_lines(lines, number == np.repeat(heights, heights) - 1, number)
    out, line, at = [], 0, 0
    for h in heights:
        line += h
        out.append(_frame_header(h) + coded[at : ends[line - 1]])
        at = int(ends[line - 1])
    return out


def write_avis(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose length is a positive multiple of 64. Frames are coded
    ``LINES_AT_ONCE`` lines at a time, so a long payload needs no more memory for it than others."""
    heights = [min(MAX_HEIGHT, len(p) // WIDTH) for p in payloads]
    filled = [p + b"\0" * (-len(p) % (WIDTH * h)) for p, h in zip(payloads, heights, strict=True)]
    of_frame = [h for p, h in zip(filled, heights, strict=True) for _ in range(len(p) // (WIDTH * h))]
    lines = np.frombuffer(b"".join(filled), np.uint8).reshape(-1, WIDTH)
    frames: list[bytes] = []
    first, at, line = 0, 0, 0
    for i, h in enumerate([*of_frame, LINES_AT_ONCE]):
        if line + h - at > LINES_AT_ONCE and i > first:
            frames += _frames(lines[at:line], of_frame[first:i])
            first, at = i, line
        line += h
    out, done = [], 0
    for p, f, h in zip(payloads, filled, heights, strict=True):
        n = len(f) // (WIDTH * h)
        out.append(_avi(frames[done : done + n], h, len(p)))
        done += n
    return out


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, size
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> dict:
    """Frame positions from the idx1 index, and the headers' figures. Raises ValueError if the
    bytes aren't such a file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    end = 8 + struct.unpack_from("<I", data, 4)[0]
    if end > len(data):
        raise ValueError("an AVI file that breaks off")
    found: dict = {"frames": []}
    lists = [(12, end)]
    while lists:
        at, end = lists.pop(0)
        for name, start, size in _chunks(data, at, end):
            if name == b"LIST" and data[start : start + 4] == b"movi":
                found["movi"] = start
            elif name == b"LIST":
                lists.append((start + 4, start + size))
            elif name == b"avih":
                found["microseconds"], found["height"] = struct.unpack_from("<I32xI", data, start)
            elif name == b"strd":
                found["samples"] = struct.unpack_from("<Q", data, start)[0]
            elif name == b"idx1":
                found["index"] = [struct.unpack_from("<4sIII", data, start + i) for i in range(0, size, 16)]
    if not {"movi", "microseconds", "index"} <= found.keys():
        raise ValueError("an AVI file without header, frames or index")
    for name, _, offset, size in found["index"]:
        start = found["movi"] + offset
        if data[start : start + 4] != name or struct.unpack_from("<I", data, start + 4)[0] != size:
            raise ValueError("the index doesn't fit the frames")
        found["frames"].append((start + 8, size))
    return found


def _coded_at(frame: bytes) -> int:
    """Where the coded data of a frame begins. Raises ValueError if it isn't such a frame."""
    at = 2
    while frame[:2] == b"\xff\xd8" and at + 4 <= len(frame):
        mark, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        at += 2 + length
        if mark == 0xDA:
            return at
    raise ValueError("a JPEG frame without a scan")


def read_lines(frames: list[bytes], form: FrameFormat) -> np.ndarray:
    """Decode the lines of many frames of one format, whatever their heights, in step."""
    data = np.frombuffer(b"".join(frames), np.uint8)
    marker = np.flatnonzero((data[:-1] == 255) & (data[1:] != 0))
    keep = np.ones(len(data), bool)
    keep[marker] = keep[marker + 1] = False
    keep[1:] &= ~((data[:-1] == 255) & (data[1:] == 0))
    begin = np.concatenate([[0], marker[:-1] + 2])
    clean = np.concatenate([data[keep], np.zeros(3, np.uint8)]).astype(np.uint32)
    word = clean[:-2] << 16 | clean[1:-1] << 8 | clean[2:]
    kept_before = np.concatenate([[0], np.cumsum(keep)])
    bit = 8 * kept_before[begin]
    value = np.full(len(begin), 128, np.int32)
    out = np.empty((form.width, len(begin)), np.uint8)
    for i in range(form.width):
        window = (word[np.minimum(bit >> 3, len(word) - 1)] >> (24 - LOOK_BITS - (bit & 7)).astype(np.uint32)) & np.uint32((1 << LOOK_BITS) - 1)
        if not form.taken[window].all():
            raise ValueError("a JPEG frame with codes that its table lacks")
        value += form.difference[window]
        out[i] = value
        bit += form.taken[window]
    return out.T


def read_avis(files: list[bytes]) -> list[tuple[dict, np.ndarray]]:
    """For each file its parsed headers and frames x samples. Frames of one width and table are
    decoded together, about ``LINES_AT_ONCE`` lines at a time."""
    parsed = [parse_avi(f) for f in files]
    frames, forms = [], []
    for f, p in zip(files, parsed, strict=True):
        for at, n in p["frames"]:
            frame = f[at : at + n]
            begin = _coded_at(frame)
            form = _format(frame[:begin])
            if form.height != p["height"]:
                raise ValueError("a frame of another height than the file")
            forms.append(form)
            frames.append(frame[begin:])
    samples: list[np.ndarray | None] = [None] * len(frames)
    groups: dict[tuple, list[int]] = {}
    for i, form in enumerate(forms):
        groups.setdefault((form.width, id(form.difference)), []).append(i)
    for group in groups.values():
        while group:
            n, line = 0, 0
            while n < len(group) and (not n or line + forms[group[n]].height <= LINES_AT_ONCE):
                line += forms[group[n]].height
                n += 1
            part, group = group[:n], group[n:]
            lines, at = read_lines([frames[i] for i in part], forms[part[0]]), 0
            if len(lines) != line:
                raise ValueError("a frame with other lines than its height")
            for i in part:
                samples[i] = np.ascontiguousarray(lines[at : at + forms[i].height]).reshape(-1)
                at += forms[i].height
    out, done = [], 0
    for p in parsed:
        n = len(p["frames"])
        out.append((p, np.stack(samples[done : done + n]) if n else np.zeros((0, 0), np.uint8)))
        done += n
    return out
