"""FLAC columns: 8-bit mono streams, coded and decoded frame by frame as numpy arrays.

The encoder writes fixed and linear predictors with Rice residuals, constant and verbatim
subframes, checksums, STREAMINFO with the samples' MD5 and a SEEKTABLE with a point for every
frame. Bytes of text are no wave: as samples they go through a fixed one-to-one table of levels, as
companding does, so that frequent letters are quiet and residuals short; an APPLICATION block names
the table. With the seek table the decoder takes all frames of all rows of a batch at once: one step of the Rice
decoder or of the predictor is an array operation over frames. Streams without such a table, and
frames of forms that this encoder doesn't write (several channels, other block sizes, partitions,
escapes, wasted bits), go through a plain decoder bit by bit.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.textvec import utf8
from tallyspark.plans.session import ship_code, workspace
from tallyspark.plans.tables import table

#: Samples of a block; payloads are filled up to a multiple of it.
BLOCK = 576
FILL = 255
RATE = 8000
#: Order and coefficient bits of linear predictors.
ORDER, PRECISION = 8, 10
MAX_RICE = 14
#: Frames that are coded together.
GROUP = 2048
#: Byte values from the quietest level on; all others follow in natural order. The fill is quiet too.
QUIET = b" eanitrsoudlhcm\xffgpbfvwkyzxjq.,\n\xc3"
#: The id of the APPLICATION block that says that samples are levels of this table.
LEVEL_BLOCK = b"\x02\x00\x00\x08lvlsT001"
FIXED = ([], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1])
SEEK = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])


def _levels() -> np.ndarray:
    """The sample of each byte value: 0, -1, 1, -2 and so on in the order of ``QUIET``."""
    order = list(QUIET) + [b for b in range(256) if b not in QUIET]
    rank = np.empty(256, np.int64)
    rank[order] = np.arange(256)
    return ((rank >> 1) ^ -(rank & 1)).astype(np.int8)


LEVEL = _levels()
#: The byte of each sample, by the sample's low eight bits.
BYTE = np.argsort(LEVEL.view(np.uint8)).astype(np.uint8)


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out, top, mask = [], 1 << bits - 1, (1 << bits) - 1
    for byte in range(256):
        crc = byte << bits - 8
        for _ in range(8):
            crc = (crc << 1 ^ (poly if crc & top else 0)) & mask
        out.append(crc)
    return np.array(out, dtype=np.uint16 if bits == 16 else np.uint8)


CRC8, CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of many byte spans at once."""
    order = np.argsort(-lengths, kind="stable")
    at, left = starts[order], lengths[order]
    crc = np.zeros(len(at), np.uint16)
    active = np.searchsorted(-left, -np.arange(int(left[0]) if len(left) else 0), "left")
    for t, n in enumerate(active):
        c = crc[:n]
        crc[:n] = (c << np.uint16(8)) ^ CRC16[(c >> np.uint16(8)) ^ data[at[:n] + t]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _coded_number(n: int) -> bytes:
    """UTF-8's scheme for numbers up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    tail = []
    room = 0x3F
    while n > room:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        room >>= 1
    return bytes([0xFF << 7 - len(tail) & 0xFF | n, *reversed(tail)])


def _crc8(data: bytes) -> int:
    crc = 0
    for b in data:
        crc = int(CRC8[crc ^ b])
    return crc


_HEADERS: dict[int, bytes] = {}


def _frame_header(number: int) -> bytes:
    """Sync code, fixed block size of 576, rate from STREAMINFO, one channel, 8 bits; number; CRC-8."""
    found = _HEADERS.get(number)
    if found is None:
        head = b"\xff\xf8\x20\x02" + _coded_number(number)
        found = head + bytes([_crc8(head)])
        if number < 4096:
            _HEADERS[number] = found
    return found


def _lpc(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients (frames x ORDER) and shifts by autocorrelation and Levinson's recursion."""
    f = x.astype(np.float64)
    auto = np.stack([np.einsum("ij,ij->i", f[:, : BLOCK - k], f[:, k:]) for k in range(ORDER + 1)], axis=1)
    error = np.maximum(auto[:, 0], 1e-9) * (1 + 1e-9)
    coefs = np.zeros((len(x), ORDER))
    for i in range(ORDER):
        k = (auto[:, i + 1] - np.einsum("ij,ij->i", coefs[:, :i], auto[:, i:0:-1])) / error
        new = coefs.copy()
        new[:, i] = k
        new[:, :i] -= k[:, None] * coefs[:, :i][:, ::-1]
        coefs = new
        error = np.maximum(error * (1 - k * k), 1e-9)
    limit = 2 ** (PRECISION - 1) - 1
    top = np.maximum(np.abs(coefs).max(axis=1), 1e-6)
    shift = np.clip(np.floor(np.log2(limit / top)), 0, 14).astype(np.int32)
    return np.clip(np.rint(coefs * 2.0 ** shift[:, None]), -limit - 1, limit).astype(np.int32), shift


def _rice(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parameter, bits) of each row of non-negative residuals, of the parameters about the mean's."""
    n = u.shape[1]
    guess = np.clip(np.floor(np.log2(np.maximum(u.mean(axis=1) * 0.7, 1e-9))), 0, MAX_RICE).astype(np.uint32)
    best_k, best = guess, None
    for step in (0, 1, -1):
        k = np.clip(guess.astype(np.int64) + step, 0, MAX_RICE).astype(np.uint32)
        bits = (u >> k[:, None]).sum(axis=1, dtype=np.int64) + n * (k.astype(np.int64) + 1)
        if best is None:
            best_k, best = k, bits
        else:
            better = bits < best
            best_k, best = np.where(better, k, best_k), np.where(better, bits, best)
    return best_k, best


def _zigzag(r: np.ndarray) -> np.ndarray:
    return ((r << 1) ^ (r >> 31)).astype(np.uint32)


def _encode_group(x: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames of samples (frames x BLOCK, -128 to 127) as (bytes one after the other, lengths)."""
    frames = len(x)
    constant = (x == x[:, :1]).all(axis=1)
    # Candidates: (bits of the subframe, order, Rice parameter, residuals); order codes as in the subframe type.
    residuals, d = [], x
    for order in range(3):
        residuals.append((8 + order, order, _zigzag(d[:, order:] if order == 0 else d)))
        d = np.diff(d, axis=1)
    coefs, shift = _lpc(x)
    predicted = np.zeros((frames, BLOCK - ORDER), np.int32)
    for j in range(ORDER):
        predicted += coefs[:, j : j + 1] * x[:, ORDER - 1 - j : BLOCK - 1 - j]
    residuals.append((32 + ORDER - 1, ORDER, _zigzag(x[:, ORDER:] - (predicted >> shift[:, None]))))
    kind = np.where(constant, 0, 1)
    bits = np.where(constant, 8, 8 * BLOCK)
    k = np.zeros(frames, np.uint32)
    for code, order, u in residuals:
        own_k, own = _rice(u)
        own = own + 8 * order + 10 + (9 + ORDER * PRECISION if code >= 32 else 0)
        better = (own < bits) & ~constant
        kind, bits, k = np.where(better, code, kind), np.where(better, own, bits), np.where(better, own_k, k)
    heads = [_frame_header(int(n)) for n in numbers]
    head_sizes = np.fromiter(map(len, heads), np.int64, frames)
    lengths = head_sizes + (8 + bits + 7) // 8 + 2
    starts = np.cumsum(lengths) - lengths
    words = np.zeros(int(starts[-1] + lengths[-1]) // 4 + 4, np.float64)  # sums of 32-bit fields are exact in it

    def put(at: np.ndarray, size: np.ndarray | int, value: np.ndarray):
        """Adds fields of up to 32 bits at bit places where nothing is yet."""
        at, value = at.ravel(), value.ravel().astype(np.uint64)
        wide = value << (np.uint64(64) - (at & 31).astype(np.uint64) - np.asarray(size).astype(np.uint64).ravel())
        index = at >> 5
        low = wide & np.uint64(0xFFFFFFFF)
        words[:] += np.bincount(index, weights=(wide >> np.uint64(32)).astype(np.float64), minlength=len(words))
        words[:] += np.bincount(index + 1, weights=low.astype(np.float64), minlength=len(words))

    bit = (starts + head_sizes) * 8
    put(bit, 8, kind << 1)
    bit = bit + 8
    raw = (x & 0xFF).astype(np.uint64)
    put(bit[constant], 8, raw[constant, 0])
    verbatim = kind == 1
    put(bit[verbatim, None] + 8 * np.arange(BLOCK), 8, raw[verbatim])
    for code, order, u in residuals:
        own = kind == code
        if not own.any():
            continue
        at = bit[own]
        put(at[:, None] + 8 * np.arange(order), 8, raw[own, :order])
        at = at + 8 * order
        if code >= 32:
            put(at, 9, (PRECISION - 1 << 5 | shift[own]))
            put(at[:, None] + 9 + PRECISION * np.arange(ORDER), PRECISION, coefs[own] & (1 << PRECISION) - 1)
            at = at + 9 + ORDER * PRECISION
        put(at, 10, k[own])
        own_k, own_u = k[own, None].astype(np.uint32), u[own]
        quotient = (own_u >> own_k).astype(np.int64)
        size = own_k.astype(np.int64) + 1
        end = at[:, None] + 10 + np.cumsum(quotient + size, axis=1)
        value = (np.uint32(1) << own_k) | (own_u & ((np.uint32(1) << own_k) - np.uint32(1)))
        put(end - size, np.broadcast_to(size, end.shape), value)
    out = np.frombuffer(words.astype(np.uint32).astype(">u4").tobytes(), np.uint8)[: int(starts[-1] + lengths[-1])].copy()
    for size in np.unique(head_sizes):
        own = np.flatnonzero(head_sizes == size)
        out[starts[own, None] + np.arange(size)] = np.frombuffer(b"".join(heads[i] for i in own), np.uint8).reshape(-1, size)
    sums = crc16(out, starts, lengths - 2)
    out[starts + lengths - 2], out[starts + lengths - 1] = sums >> 8, sums & 0xFF
    return out, lengths


def encode(samples: list[np.ndarray], application: bytes = b"") -> list[bytes]:
    """A FLAC stream for each array of 8-bit samples (int8); lengths are positive multiples of BLOCK. ``application`` is a block of metadata."""
    counts = np.array([len(p) // BLOCK for p in samples], dtype=np.int64)
    flat = np.concatenate(samples).reshape(-1, BLOCK)
    numbers = np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)
    parts, sizes = [], []
    for at in range(0, len(flat), GROUP):
        part, lengths = _encode_group(flat[at : at + GROUP].astype(np.int32), numbers[at : at + GROUP])
        parts.append(part)
        sizes.append(lengths)
    body, sizes = np.concatenate(parts), np.concatenate(sizes)
    ends = np.cumsum(sizes)
    out, frame = [], 0
    for payload, n in zip(samples, counts.tolist(), strict=True):
        own = sizes[frame : frame + n]
        begin = int(ends[frame] - sizes[frame])
        points = np.zeros(n, SEEK)
        points["sample"] = np.arange(n) * BLOCK
        points["offset"] = np.cumsum(own) - own
        points["samples"] = BLOCK
        info = BLOCK.to_bytes(2, "big") * 2 + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | n * BLOCK).to_bytes(8, "big") + hashlib.md5(payload.tobytes()).digest()
        table_bytes = points.tobytes()
        if len(table_bytes) < 1 << 24:
            meta = b"\x00\x00\x00\x22" + info + application + b"\x83" + len(table_bytes).to_bytes(3, "big") + table_bytes
        else:  # a block of metadata has no more than 16 MB: points for some of the frames then
            some = points[:: -(-len(points) // 900_000)].tobytes()
            meta = b"\x00\x00\x00\x22" + info + application + b"\x83" + len(some).to_bytes(3, "big") + some
        out.append(b"fLaC" + meta + body[begin : int(ends[frame + n - 1])].tobytes())
        frame += n
    return out


@dataclass
class Stream:
    """What the metadata of a stream say; ``points`` is None without a seek table."""

    block: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    points: np.ndarray | None
    audio: int
    levels: bool = False


def metadata(data: bytes) -> Stream:
    if data[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, info, points, last, levels = 4, b"", None, False, False
    while not last:
        last, kind, size = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if len(body) < size:
            raise ValueError("the metadata are cut off")
        if kind == 0:
            info = body
        elif kind == 3:
            points = np.frombuffer(body, SEEK)
            points = points[points["sample"] != np.uint64(2**64 - 1)]
        elif kind == 2:
            levels |= body == LEVEL_BLOCK[4:]
        at += 4 + size
    bits = int.from_bytes(info[10:18], "big")
    return Stream(int.from_bytes(info[2:4], "big"), (bits >> 41 & 7) + 1, (bits >> 36 & 31) + 1, bits & (1 << 36) - 1, info[18:34], points, at, levels)


def _decode_group(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray | None:
    """Frames of this encoder's form as samples (frames x BLOCK); None if one has another form. Checksums are verified."""
    if (lengths < 10).any() or (data[starts] != 0xFF).any():
        return None
    if not ((data[starts + 1] == 0xF8) & (data[starts + 2] == 0x20) & (data[starts + 3] == 0x02)).all():
        return None
    lead = data[starts + 4]
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [0, 1, 2, 3, 4], 5)
    crc = np.zeros(len(starts), np.uint8)
    for t in range(4 + 1 + int(extra.max())):
        crc = np.where(t < 5 + extra, CRC8[crc ^ data[starts + t]], crc)
    head = starts + 5 + extra
    if (crc != data[head]).any():
        raise ValueError("a frame header's checksum is wrong")
    found = crc16(data, starts, lengths - 2)
    if (found != data[starts + lengths - 2].astype(np.uint16) << 8 | data[starts + lengths - 1]).any():
        raise ValueError("a frame's checksum is wrong")
    sub = data[head + 1]
    if (sub & 0x81).any():
        return None
    kind = (sub >> 1).astype(np.int64)
    lpc = kind >= 32
    if not ((kind <= 1) | (kind >= 8) & (kind <= 12) | lpc).all():
        return None
    order = np.where(lpc, kind - 31, np.where(kind >= 8, kind - 8, 0))
    rice = kind >= 8
    out = np.empty((BLOCK, len(starts)), np.int32)
    body = head + 2
    signed = data.view(np.int8)
    own = np.flatnonzero(kind == 0)
    out[:, own] = signed[body[own]]
    own = np.flatnonzero(kind == 1)
    if len(own):
        out[:, own] = signed[body[own] + np.arange(BLOCK)[:, None]]
    own = np.flatnonzero(rice)
    if not len(own):
        return out.T
    own = own[np.argsort(order[own], kind="stable")]
    # 64 bits from every byte on; a frame's last bytes are followed by others or by padding.
    wide = np.zeros(len(data) - 7, np.uint64)
    for t in range(8):
        wide |= data[t : t + len(wide)].astype(np.uint64) << np.uint64(56 - 8 * t)

    def take(at: np.ndarray, size) -> np.ndarray:
        return (wide[at >> 3] << (at & 7).astype(np.uint64)) >> (np.uint64(64) - np.asarray(size).astype(np.uint64))

    orders, bit = order[own], body[own] * 8
    top = int(orders.max())
    warm = np.zeros((top, len(own)), np.int32)
    for t in range(top):
        active = np.flatnonzero(orders > t)
        warm[t, active] = signed[(bit[active] >> 3) + t]
    bit = bit + 8 * orders
    coefs = np.zeros((top, len(own)), np.int64)
    shift = np.zeros(len(own), np.int64)
    for n in range(min(5, top + 1)):
        same = np.flatnonzero((orders == n) & ~lpc[own])
        for j, c in enumerate(FIXED[n]):
            coefs[j, same] = c
    linear = np.flatnonzero(lpc[own])
    if len(linear):
        precision = take(bit[linear], 4).astype(np.int64) + 1
        shift[linear] = take(bit[linear] + 4, 5).astype(np.int64)
        if (shift[linear] > 15).any() or (precision == 16).any():
            return None
        at = bit[linear] + 9
        for j in range(top):
            has = orders[linear] > j
            value = take(at, precision).astype(np.int64)
            coefs[j, linear] = np.where(has, value - ((value >> precision - 1) << precision), 0)
            at = at + np.where(has, precision, 0)
        bit[linear] = at
    head_bits = take(bit, 10)
    if (head_bits >> np.uint64(4)).any() or (head_bits == 15).any():
        return None  # other coding methods, partitions or escapes
    k = head_bits.copy()
    bit = bit + 10
    coded = np.zeros((BLOCK, len(own)), np.uint32)
    down = np.uint64(63) - k
    ends = np.searchsorted(orders, BLOCK - np.arange(BLOCK), "left")  # frames with a residual at each step
    limit = (len(data) - 8) * 8
    for t in range(BLOCK - int(orders[0])):
        n = int(ends[t])
        at = bit[:n]
        v = wide[at >> 3] << (at & 7).astype(np.uint64)
        high = (v >> np.uint64(32)).astype(np.float64)
        zeros = 31 - ((high.view(np.int64) >> 52) - 1023)
        rest = v << (zeros + 1).astype(np.uint64)
        if not high.all():  # 32 zeros or more
            slow = np.flatnonzero(high == 0)
            zeros[slow] = [_zeros(data, int(at[i]), limit) for i in slow]
            after = at[slow] + zeros[slow] + 1
            rest[slow] = wide[after >> 3] << (after & 7).astype(np.uint64)
        u = (zeros.astype(np.uint64) << k[:n]) | ((rest >> np.uint64(1)) >> down[:n])
        coded[t, :n] = u
        bit[:n] = at + zeros + 1 + k[:n].astype(np.int64)
    residual = (coded >> np.uint32(1)).astype(np.int32) ^ -(coded & np.uint32(1)).astype(np.int32)
    for n in np.unique(orders):
        same = slice(int(np.searchsorted(orders, n, "left")), int(np.searchsorted(orders, n, "right")))
        x = np.empty((BLOCK, same.stop - same.start), np.int64)
        x[:n] = warm[:n, same]
        e, c, s = residual[:, same], coefs[:, same], shift[same]
        if n == 0:
            x[:] = e
        for t in range(n, BLOCK if n else 0):
            guess = c[0] * x[t - 1]
            for j in range(1, n):
                guess += c[j] * x[t - 1 - j]
            x[t] = e[t - n] + (guess >> s)
        out[:, own[same]] = x
    return out.T


def _zeros(data: np.ndarray, bit: int, limit: int) -> int:
    n = 0
    while bit + n < limit and not data[bit + n >> 3] >> 7 - (bit + n & 7) & 1:
        n += 1
    return n


class _Bits:
    """Bits of bytes, one field after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at * 8

    def get(self, n: int) -> int:
        if not n:
            return 0
        first, last = self.at >> 3, self.at + n + 7 >> 3
        if last > len(self.data):
            raise ValueError("the stream is cut off")
        value = int.from_bytes(self.data[first:last], "big") >> last * 8 - self.at - n
        self.at += n
        return value & (1 << n) - 1

    def signed(self, n: int) -> int:
        value = self.get(n)
        return value - (1 << n) if n and value >> n - 1 else value

    def unary(self) -> int:
        n = 0
        while not self.get(1):
            n += 1
        return n


def _plain_subframe(bits: _Bits, block: int, depth: int) -> list[int]:
    if bits.get(1):
        raise ValueError("no subframe begins here")
    kind = bits.get(6)
    wasted = bits.unary() + 1 if bits.get(1) else 0
    depth -= wasted
    if kind == 0:
        x = [bits.signed(depth)] * block
    elif kind == 1:
        x = [bits.signed(depth) for _ in range(block)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 31 if kind >= 32 else kind - 8
        x = [bits.signed(depth) for _ in range(order)]
        coefs, shift = FIXED[order] if kind < 32 else [], 0
        if kind >= 32:
            precision = bits.get(4) + 1
            shift = bits.signed(5)
            coefs = [bits.signed(precision) for _ in range(order)]
        width = 5 if bits.get(2) else 4
        parts = bits.get(4)
        for part in range(1 << parts):
            k = bits.get(width)
            raw = bits.get(5) if k == (1 << width) - 1 else None
            for _ in range((block >> parts) - (0 if part else order)):
                if raw is not None:
                    e = bits.signed(raw)
                else:
                    u = bits.unary() << k | bits.get(k)
                    e = u >> 1 ^ -(u & 1)
                x.append(e + (sum(c * x[-1 - j] for j, c in enumerate(coefs)) >> shift))
    else:
        raise ValueError("the subframe's type is reserved")
    return [v << wasted for v in x]


def _plain_frame(data: bytes, at: int, stream: Stream) -> tuple[list[list[int]], int]:
    """(samples by channel, end) of the frame at ``at``, bit by bit; any form of frame."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame begins here")
    bits = _Bits(data, at + 2)
    size, rate, channels, depth, _ = bits.get(4), bits.get(4), bits.get(4), bits.get(3), bits.get(1)
    lead = bits.get(8)
    for _ in range(max(0, 7 - (lead ^ 0xFF).bit_length() - 1) if lead >= 0x80 else 0):
        bits.get(8)
    block = bits.get(8) + 1 if size == 6 else bits.get(16) + 1 if size == 7 else 192 if size == 1 else 144 << size if size <= 5 else 1 << size
    bits.get({12: 8, 13: 16, 14: 16}.get(rate, 0))
    end = bits.at >> 3
    if _crc8(data[at:end]) != bits.get(8):
        raise ValueError("a frame header's checksum is wrong")
    depth = {0: stream.bits, 1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}[depth]
    count = channels + 1 if channels < 8 else 2
    found = [_plain_subframe(bits, block, depth + (channels == 8 and c == 1 or channels == 9 and c == 0 or channels == 10 and c == 1)) for c in range(count)]
    if channels == 8:
        found[1] = [a - b for a, b in zip(*found, strict=True)]
    elif channels == 9:
        found[0] = [a + b for a, b in zip(*found, strict=True)]
    elif channels == 10:
        both = [(m << 1 | s & 1, s) for m, s in zip(*found, strict=True)]
        found = [[m + s >> 1 for m, s in both], [m - s >> 1 for m, s in both]]
    end = bits.at + 7 >> 3
    crc = int(crc16(np.frombuffer(data, np.uint8), np.array([at]), np.array([end - at]))[0])
    if crc != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("a frame's checksum is wrong")
    return found, end + 2


def _plain(data: bytes, stream: Stream, at: int, end: int) -> np.ndarray:
    """Samples of the frames from ``at`` to ``end``, channels beside each other."""
    parts = [np.zeros((0, stream.channels), np.int32)]
    while at < end:
        found, at = _plain_frame(data, at, stream)
        parts.append(np.array(found, np.int32).T)
    return np.concatenate(parts)


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream (int32; of several channels: samples x channels). Checksums and MD5 are verified.

    A stream that is damaged or cut off raises ValueError.
    """
    metas = [metadata(s) for s in streams]
    quick = [m.points is not None and m.channels == 1 and m.bits == 8 and m.block == BLOCK and len(m.points) * BLOCK == m.samples and (m.points["samples"] == BLOCK).all() for m in metas]
    out: list[np.ndarray | None] = [None] * len(streams)
    fast = [i for i, q in enumerate(quick) if q and metas[i].samples]
    if fast:
        base = np.cumsum([0] + [len(streams[i]) for i in fast])
        data = np.frombuffer(b"".join([*[streams[i] for i in fast], bytes(16)]), np.uint8)
        starts = np.concatenate([b + metas[i].audio + metas[i].points["offset"].astype(np.int64) for b, i in zip(base, fast, strict=False)])
        counts = [len(metas[i].points) for i in fast]
        last = np.cumsum(counts) - 1
        ends = np.append(starts[1:], 0)
        ends[last] = base[1:]
        if (ends > base[-1]).any() or (starts >= ends).any():
            raise ValueError("the seek table is wrong")
        parts = []
        for at in range(0, len(starts), GROUP):
            own, stop = starts[at : at + GROUP], ends[at : at + GROUP]
            low, high = int(own[0]), int(stop[-1])
            found = _decode_group(data[low : high + 16], own - low, stop - own)
            if found is None:
                parts = None
                break
            parts.append(found.astype(np.int8))
        if parts is not None:
            flat = np.concatenate(parts).reshape(-1)
            at = 0
            for i, n in zip(fast, counts, strict=True):
                out[i] = flat[at : at + n * BLOCK]
                at += n * BLOCK
    for i, (s, m) in enumerate(zip(streams, metas, strict=True)):
        if out[i] is None:
            x = _plain(s, m, m.audio, len(s))
            out[i] = x[:, 0] if m.channels == 1 else x
        size = (m.bits + 7) // 8
        pcm = out[i].astype(np.int8) if size == 1 else np.frombuffer(out[i].astype("<i4").tobytes(), np.uint8).reshape(-1, 4)[:, :size]
        if m.samples and len(out[i]) != m.samples or any(m.md5) and hashlib.md5(pcm.tobytes()).digest() != m.md5:
            raise ValueError("the samples' length or MD5 is wrong")
    return out


def seek(data: bytes, sample: int, n: int) -> np.ndarray:
    """``n`` samples from ``sample`` on of a mono stream; only the frames that hold them are decoded."""
    return seek_all([data], [sample], n)[0]


def seek_all(streams: list[bytes], samples: list[int], n: int) -> list[np.ndarray]:
    """``n`` samples from a place of each mono stream on, by the seek tables; frames of this encoder's form are decoded together."""
    out: list[np.ndarray | None] = [None] * len(streams)
    own, parts, starts, lengths, size = [], [], [], [], 0
    for i, (data, sample) in enumerate(zip(streams, samples, strict=True)):
        m = metadata(data)
        if m.points is None or not len(m.points):
            out[i] = decode([data])[0][sample : sample + n]
            continue
        first = int(np.searchsorted(m.points["sample"], sample, "right")) - 1
        last = max(first + 1, int(np.searchsorted(m.points["sample"], sample + n, "left")))
        ends = np.append(m.points["offset"][first:last].astype(np.int64), int(m.points["offset"][last]) if last < len(m.points) else len(data) - m.audio)
        skip = sample - int(m.points["sample"][first])
        part = data[m.audio + int(ends[0]) : m.audio + int(ends[-1])]
        if m.channels == 1 and m.bits == 8 and m.block == BLOCK and len(m.points) * BLOCK == m.samples:
            own.append((i, skip, last - first))
            parts.append(part)
            starts.append(ends[:-1] - ends[0] + size)
            lengths.append(np.diff(ends))
            size += len(part)
        else:
            out[i] = _plain(part, m, 0, len(part))[:, 0][skip : skip + n]
    if own:
        found = _decode_group(np.frombuffer(b"".join([*parts, bytes(16)]), np.uint8), np.concatenate(starts), np.concatenate(lengths))
        at = 0
        for (i, skip, frames), part in zip(own, parts, strict=True):
            x = found[at : at + frames].reshape(-1) if found is not None else _plain(part, metadata(streams[i]), 0, len(part))[:, 0]
            out[i] = x[skip : skip + n]
            at += frames
    return out


def payload_of(text: np.ndarray) -> np.ndarray:
    """Bytes filled up with 255 to a positive multiple of BLOCK."""
    room = -len(text) % BLOCK if len(text) else BLOCK
    return np.concatenate([text, np.full(room, FILL, np.uint8)]) if room else text


def bytes_of(samples: np.ndarray, levels: bool) -> np.ndarray:
    """Unsigned 8-bit PCM of samples: through the table of levels, or offset by 128."""
    low = (samples.astype(np.int64) & 0xFF).astype(np.uint8)
    return BYTE[low] if levels else low ^ 0x80


def encode_column(rows: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, n_bytes and media (the FLAC stream of the padded UTF-8 bytes).

    Null and empty texts are a block of fill. Repeated rows stay rows of their own with equal media;
    an empty table gives no row; columns other than ``keep`` are left out, whatever their names.
    Texts are taken in runs of 2 MB, a longer one by itself.
    """
    ship_code(rows.sparkSession)
    source = rows.select(*[rows[c] for c in keep], rows[text].alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in _runs(batch.column(batch.num_columns - 1)):
                part = batch.slice(at, stop - at)
                data, offsets = utf8(part.column(part.num_columns - 1))
                media = encode([LEVEL[payload_of(data[a:b])] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)], LEVEL_BLOCK)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(offsets)), pa.array(media, pa.binary())], names=[*keep, "n_bytes", "media"])

    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}, n_bytes bigint, media binary")


def stored(media: DataFrame, path: str) -> DataFrame:
    """Writes a table with media to ``path`` and reads it again."""
    media.write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(media.schema).parquet(path)


def _runs(column: pa.Array, size: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``size`` bytes."""
    _, offsets = utf8(column)
    at = 0
    while at < len(column):
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, min(stop, len(column))
        at = stop


#: Samples of a PCM block, and of the end of a stream that is read by seeking.
PCM_SAMPLES, TAIL = 65536, 32


def pcm_blocks(media: DataFrame, samples: int = PCM_SAMPLES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The decoded blocks of each stream, in order: ``keep`` columns, sample_offset, n_samples, samples (of the whole stream), tail and pcm.

    pcm are unsigned 8-bit samples; tail the last ``TAIL`` of the stream, found by seeking. Frames'
    checksums, lengths and MD5 are verified; a damaged stream fails. Null media give no block.
    Repeated rows give their blocks as often; an empty table gives none. A batch's streams are
    decoded 2 MB at a time.
    """
    ship_code(media.sparkSession)
    source = media.where("media IS NOT NULL").select(*keep, "media")
    added = [("sample_offset", pa.int64()), ("n_samples", pa.int64()), ("samples", pa.int64()), ("tail", pa.binary()), ("pcm", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, stop in _runs(batch.column(batch.num_columns - 1)):
                streams = batch.column(batch.num_columns - 1).slice(first, stop - first).to_pylist()
                metas = [metadata(x) for x in streams]
                tails = seek_all(streams, [max(0, m.samples - TAIL) for m in metas], TAIL)
                rows, blocks = [], []
                for i, (found, m, tail) in enumerate(zip(decode(streams), metas, tails, strict=True)):
                    pcm, end = bytes_of(found, m.levels), bytes_of(tail, m.levels).tobytes()
                    for at in range(0, len(pcm), samples):
                        part = pcm[at : at + samples]
                        rows.append(first + i)
                        blocks.append((at, len(part), len(pcm), end, part.tobytes()))
                columns = [pa.array([b[k] for b in blocks], t) for k, (_, t) in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*[c.take(pa.array(rows, pa.int64())) for c in batch.columns[:-1]], *columns], names=[*keep, *[n for n, _ in added]])

    fields = ", ".join(f"`{c}` {media.schema[c].dataType.simpleString()}" for c in keep)
    return source.mapInArrow(run, f"{fields}, sample_offset bigint, n_samples bigint, samples bigint, tail binary, pcm binary")


def write_pcm(media: DataFrame, path: str, samples: int = PCM_SAMPLES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Writes the PCM blocks of each stream to a table at ``path`` and reads it again: ``keep`` columns, block, sample_offset, n_samples, samples, pcm.

    block is sample_offset divided by ``samples``, so that a sample's block is known without a look-up.
    Each task sorts its blocks by the first of ``keep`` and block, so that a look-up of some keys reads
    few row groups. A task that runs again writes equal rows; nothing is seen before all is written.
    """
    blocks = pcm_blocks(media, samples, keep).withColumn("block", F.floor(F.col("sample_offset") / samples))
    blocks = blocks.select(*keep, "block", "sample_offset", "n_samples", "samples", "pcm")
    blocks.sortWithinPartitions(keep[0], "block").write.option("compression", "zstd").parquet(path)
    return media.sparkSession.read.schema(blocks.schema).parquet(path)


def pcm_ranges(blocks: DataFrame, wanted: DataFrame, samples: int = PCM_SAMPLES, key: str = "doc_id") -> DataFrame:
    """``key``, start and length of ``wanted`` (its other columns are left out), sample_offset and pcm: the parts of the ranges, one for each block that a range touches.

    ``blocks`` is what ``write_pcm`` gave with the same ``samples``. A range names its blocks, which are
    joined by key and number: no range is compared with other blocks. Samples beyond a stream's end,
    negative starts' samples before 0, null or unknown keys, and ranges that are null or have no length
    give no part. Keys of several streams give parts of each. A long range stays in parts of a block.
    """
    first = F.greatest(F.col("start"), F.lit(0).cast("long"))
    stop = F.coalesce(F.try_add("start", "length"), F.lit(2**63 - 1))
    asked = wanted.select(key, F.col("start").cast("long"), F.col("length").cast("long")).where("start IS NOT NULL AND length > 0").where(stop > first).withColumn("__first", first).withColumn("__stop", stop)
    # A range far beyond a stream's end must not name blocks without end: lengths of streams bound it.
    lengths = blocks.where("block = 0").groupBy(key).agg(F.max("samples").alias("__samples"))
    asked = asked.join(lengths, key).withColumn("__stop", F.least("__stop", "__samples")).where("__stop > __first")
    each = asked.withColumn("block", F.explode(F.sequence(F.floor(F.col("__first") / samples), F.floor((F.col("__stop") - 1) / samples))))
    both = each.join(blocks.select(key, "block", "sample_offset", "n_samples", "pcm"), [key, "block"])
    at = F.greatest(F.col("__first"), F.col("sample_offset"))
    n = F.least(F.col("__stop"), F.col("sample_offset") + F.col("n_samples")) - at
    part = F.substring("pcm", (at - F.col("sample_offset") + 1).cast("int"), n.cast("int"))
    return both.where(n > 0).select(key, "start", "length", at.alias("sample_offset"), part.alias("pcm"))


class Feature:
    """Length, mean, energy, zero crossings and greatest step of a stream's samples about their middle, all from integers, block by block."""

    def __init__(self):
        self.n = self.sum = self.energy = self.crossings = self.step = 0
        self.last = None

    def add(self, pcm: np.ndarray):
        x = pcm.astype(np.int64) - 128
        if self.last is not None:
            x = np.append(self.last, x)
        self.crossings += int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
        self.step = max(self.step, int(np.abs(np.diff(x)).max()) if len(x) > 1 else 0)
        own = x[len(x) - len(pcm) :]
        self.n, self.sum, self.energy, self.last = self.n + len(pcm), self.sum + int(own.sum()), self.energy + int((own * own).sum()), own[-1]

    def __str__(self):
        return f"samples={self.n};sum={self.sum};energy={self.energy};crossings={self.crossings};step={self.step}"


DIGESTS = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def digests(media: DataFrame) -> DataFrame:
    """Digests of the PCM blocks of media (doc_id, n_bytes, media): a row for each of its rows that has media.

    Blocks are taken one at a time in the order of their offsets, so that memory doesn't follow the
    length of a stream; the tail that seeking gave must be the end of the blocks. Each block has the
    number of its row: another row's block amid a stream, or a stream without its end, fails. doc_id
    is taken as a 64-bit integer. Repeated rows give equal rows; an empty table gives none.
    """
    own = media.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    blocks = pcm_blocks(own, keep=("row", "doc_id", "n_bytes", "media_bytes", "media_sha256"))
    names = [x.split()[0] for x in DIGESTS.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, digest, seen = None, None, 0
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if row is None:
                    row, digest, values, seen, end = r["row"], hashlib.sha256(), Feature(), 0, b""
                if r["row"] != row or r["sample_offset"] != seen:
                    raise ValueError("a block doesn't follow the one before it")
                digest.update(r["pcm"])
                values.add(np.frombuffer(r["pcm"], np.uint8))
                seen, end = seen + r["n_samples"], (end + r["pcm"])[-TAIL:]
                if seen == r["samples"]:
                    if end != r["tail"]:
                        raise ValueError("seeking gives other samples")
                    done.append((r["doc_id"], r["n_bytes"], seen, digest.hexdigest(), zlib.crc32(r["tail"]), r["media_bytes"], r["media_sha256"], str(values)))
                    row = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if row is not None:
            raise ValueError("a stream has no end")

    return blocks.mapInArrow(run, DIGESTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores the media, reads them back, decodes them to PCM blocks and digests these."""
    media = encode_column(table(spark, sf_dir, "documents"))
    return digests(stored(media, f"{workspace(spark, 'flac')}/media"))
