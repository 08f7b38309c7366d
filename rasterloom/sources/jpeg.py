"""Baseline JPEG decoding: Huffman-coded, 8 bits, any sampling, restarts; grey, YCbCr or plain RGB."""

from __future__ import annotations

import re
import struct

import numpy as np

#: Place in an 8 by 8 block of the coefficients in file order: along diagonals, turning at each end.
_ORDER = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)


_COS = _cosines()


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """For every 16 bits the code that they begin with, as length * 256 + symbol; 0 where there is none."""
    table, at, used = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for s in symbols[used : used + n]:
            table[at : at + (1 << 16 - length)] = length << 8 | s
            at += 1 << 16 - length
        used += n
    return table.tolist()


class _Bits:
    """The entropy-coded bits of one restart interval; beyond the end there are ones."""

    def __init__(self, data: bytes):
        data = data.replace(b"\xff\x00", b"\xff")
        self.value, self.left = int.from_bytes(b"", "big"), 0
        self.data, self.at = data, 0

    def _fill(self, n: int) -> None:
        while self.left < n:
            part = self.data[self.at : self.at + 64]
            self.at += 64
            part = part if part else b"\xff" * 8
            self.value = (self.value & ((1 << self.left) - 1)) << 8 * len(part) | int.from_bytes(part, "big")
            self.left += 8 * len(part)

    def symbol(self, table: list[int]) -> int:
        self._fill(16)
        code = table[self.value >> self.left - 16 & 0xFFFF]
        if not code:
            raise ValueError("a code that no JPEG table has")
        self.left -= code >> 8
        return code & 255

    def signed(self, n: int) -> int:
        """n bits as a number of that magnitude; a leading 0 means negative."""
        if not n:
            return 0
        self._fill(n)
        self.left -= n
        v = self.value >> self.left & ((1 << n) - 1)
        return v if v >> n - 1 else v - (1 << n) + 1


def decode(raw: bytes) -> np.ndarray:
    """(height, width, 1 or 3) bytes; 3 channels are red, green, blue."""
    if raw[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quant, huff, parts, every, adobe = 2, {}, {}, [], 0, None
    while True:
        at = raw.index(b"\xff", at)
        kind = raw[at + 1]
        if kind in (0xFF, 0x00, 0x01):
            at += 1
            continue
        if kind == 0xD9:
            raise ValueError("a JPEG file without an image")
        size = struct.unpack(">H", raw[at + 2 : at + 4])[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if kind == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(float)
                body = body[1 + 64 * (1 + wide) :]
        elif kind == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _codes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif kind in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n not in (1, 3):
                raise ValueError("only 8-bit JPEG files with 1 or 3 channels")
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise ValueError("only baseline JPEG files")
        elif kind == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif kind == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif kind == 0xDA:
            break
    tables = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if len(tables) != len(parts):
        raise ValueError("only JPEG files with one scan")
    end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]").search(raw, at)
    intervals = re.split(rb"\xff[\xd0-\xd7]", raw[at : end.start() if end else len(raw)])
    hs, vs = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:  # one channel has no interleaving
        parts, hs, vs = [(parts[0][0], 1, 1, parts[0][3])], 1, 1
    across, down = -(-width // (8 * hs)), -(-height // (8 * vs))
    blocks = [np.zeros((down * v, across * h, 64)) for _, h, v, _ in parts]
    number = 0
    for data in intervals:
        bits, before = _Bits(data), [0] * len(parts)
        for _ in range(every or across * down):
            if number == across * down:
                break
            my, mx = divmod(number, across)
            for c, (name, h, v, _) in enumerate(parts):
                dc, ac = huff[tables[name] >> 4], huff[16 | tables[name] & 15]
                for k in range(h * v):
                    out = blocks[c][my * v + k // h, mx * h + k % h]
                    before[c] += bits.signed(bits.symbol(dc))
                    out[0] = before[c]
                    i = 1
                    while i < 64:
                        s = bits.symbol(ac)
                        if s & 15:
                            i += s >> 4
                            out[_ORDER[i]] = bits.signed(s & 15)
                            i += 1
                        elif s == 0xF0:
                            i += 16
                        else:
                            break
            number += 1
    planes = []
    for (_, h, v, q), b in zip(parts, blocks):
        scale = np.zeros(64)
        scale[_ORDER] = quant[q]
        pixel = _COS.T @ (b * scale).reshape(*b.shape[:2], 8, 8) @ _COS
        plane = pixel.transpose(0, 2, 1, 3).reshape(b.shape[0] * 8, b.shape[1] * 8) + 128
        planes.append(plane.repeat(vs // v, 0).repeat(hs // h, 1)[:height, :width])
    if len(planes) == 3 and adobe != 0:
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        planes = [y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb]
    return np.clip(np.rint(np.stack(planes, 2)), 0, 255).astype(np.uint8)
