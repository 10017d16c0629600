"""The block format: LZ77 with byte-aligned operations. A decoder, a greedy encoder, and the operations as rows.

A block is a 0 byte, the uncompressed length as a varint (0: the rest is literal) and operations. The two low bits of an operation's
first byte are its kind: 0 literals or a repeat of the last offset, 1 a copy with a 10-bit, 2 with a 16-bit offset, 3 a copy with a few
literals before it and a 16- or 21-bit offset. The first offset to repeat is 1.
"""

from __future__ import annotations

from dataclasses import dataclass

MAX_BLOCK = 8 << 20
NEAR, MIDDLE, FAR = 1024, 65_599, 2_162_687


class CorruptBlock(ValueError):
    """Bytes that are no block of the format."""


def varint(raw: bytes, at: int) -> tuple[int, int]:
    """(value, position behind it)."""
    value = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise CorruptBlock("a length is cut off")
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def put_varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


@dataclass(frozen=True)
class Op:
    """kind: literal, repeat, copy1, copy2, fused2 or copy3; literals come before the copy of fused kinds."""

    kind: str
    length: int
    offset: int
    literals: bytes
    header: int


def _number(raw: bytes, at: int, size: int) -> tuple[int, int]:
    if at + size > len(raw):
        raise CorruptBlock("an operation is cut off")
    return int.from_bytes(raw[at : at + size], "little"), at + size


def operations(raw: bytes, at: int = 0):
    """Operations from position `at` to the end."""
    last = 1
    while at < len(raw):
        start, tag = at, raw[at]
        at += 1
        kind, literals, length = tag & 3, 0, 0
        if kind == 0:
            length = (tag >> 3) + 1
            if length > 29:
                more, at = _number(raw, at, length - 29)
                length = 30 + more
            if tag & 4:
                yield Op("repeat", length, last, b"", at - start)
                continue
            if at + length > len(raw):
                raise CorruptBlock("literals are cut off")
            yield Op("literal", length, 0, raw[at : at + length], at - start)
            at += length
            continue
        if kind == 1:
            high, at = _number(raw, at, 1)
            last, length = (high << 2 | tag >> 6) + 1, (tag >> 2 & 15) + 4
            if length == 19:
                more, at = _number(raw, at, 1)
                length = 18 + more
            name = "copy1"
        elif kind == 3 and not tag & 4:
            low, at = _number(raw, at, 2)
            last, length, literals, name = low + 64, (tag >> 5) + 4, (tag >> 3 & 3) + 1, "fused2"
        else:
            if kind == 2:
                low, at = _number(raw, at, 2)
                last, code, name = low + 64, tag >> 2, "copy2"
            else:
                rest, at = _number(raw, at, 3)
                whole = rest << 8 | tag
                last, code, literals, name = (whole >> 11) + 65_536, whole >> 5 & 63, tag >> 3 & 3, "copy3"
            length = code + 4
            if code > 60:
                more, at = _number(raw, at, code - 60)
                length = 64 + more
        if at + literals > len(raw):
            raise CorruptBlock("literals are cut off")
        yield Op(name, length, last, raw[at : at + literals], at - start)
        at += literals


def decode(raw: bytes, marked: bool = True, most: int = MAX_BLOCK) -> bytes:
    """The block's bytes. marked: it starts with the format's 0 byte, which blocks in a stream leave out."""
    at = 0
    if marked:
        if raw[:1] != b"\0":
            raise CorruptBlock("not a block of this format")
        if len(raw) == 1:
            return b""
        at = 1
    size, at = varint(raw, at)
    if size == 0:
        if len(raw) - at > most:
            raise CorruptBlock("the block is too long")
        return raw[at:]
    if size > most:
        raise CorruptBlock("the block is too long")
    out = bytearray()
    for op in operations(raw, at):
        out += op.literals
        if op.kind == "literal":
            continue
        if op.offset > len(out) or len(out) + op.length > size:
            raise CorruptBlock("a copy reaches outside the block")
        start = len(out) - op.offset
        if op.offset >= op.length:
            out += out[start : start + op.length]
        else:
            unit = bytes(out[start:])
            out += (unit * (op.length // op.offset + 1))[: op.length]
    if len(out) != size:
        raise CorruptBlock(f"{len(out)} bytes instead of {size}")
    return bytes(out)


def decoded_len(raw: bytes) -> int:
    size, at = varint(raw, 1) if len(raw) > 1 else (0, 1)
    return size or len(raw) - at


def _literal(data: bytes) -> bytes:
    n = len(data)
    if not n:
        return b""
    if n <= 29:
        return bytes([n - 1 << 3]) + data
    size = 1 if n - 30 < 1 << 8 else 2 if n - 30 < 1 << 16 else 3
    return bytes([28 + size << 3]) + (n - 30).to_bytes(size, "little") + data


def _long(length: int) -> tuple[int, bytes]:
    """Six bits of a copy's length, and the bytes that follow."""
    if length <= 64:
        return length - 4, b""
    size = 1 if length - 64 < 1 << 8 else 2 if length - 64 < 1 << 16 else 3
    return 60 + size, (length - 64).to_bytes(size, "little")


def _copy(offset: int, length: int, before: bytes) -> bytes:
    """Up to a few literals and a copy of at least 4 bytes."""
    if offset <= NEAR and length <= 273:
        stored = offset - 1
        low = (stored & 3) << 6 | 1
        tail = bytes([low | (length - 4) << 2, stored >> 2]) if length <= 18 else bytes([low | 15 << 2, stored >> 2, length - 18])
        return _literal(before) + tail
    if 64 <= offset <= MIDDLE:
        stored = (offset - 64).to_bytes(2, "little")
        if 1 <= len(before) <= 4 and length <= 11:
            return bytes([3 | len(before) - 1 << 3 | length - 4 << 5]) + stored + before
        code, more = _long(length)
        return _literal(before) + bytes([2 | code << 2]) + stored + more
    if offset <= NEAR:  # long and near: the rest of a first copy is a repeat
        return _copy(offset, 273, before) + _repeat(length - 273)
    code, more = _long(length)
    fused = before if len(before) <= 3 else b""
    whole = 3 | 4 | len(fused) << 3 | code << 5 | offset - 65_536 << 11
    return (b"" if fused is before else _literal(before)) + whole.to_bytes(4, "little") + more + fused


def _repeat(length: int) -> bytes:
    if length <= 29:
        return bytes([length - 1 << 3 | 4])
    size = 1 if length - 30 < 1 << 8 else 2 if length - 30 < 1 << 16 else 3
    return bytes([28 + size << 3 | 4]) + (length - 30).to_bytes(size, "little")


def encode(data: bytes, marked: bool = True, level: int = 1) -> bytes:
    """A block of at most MAX_BLOCK bytes. Level 0 stores them; 1 takes matches as they come; from 2 on, the longest of several candidates.

    What doesn't get smaller is stored.
    """
    if len(data) > MAX_BLOCK:
        raise ValueError(f"a block has at most {MAX_BLOCK} bytes")
    lead = b"\0" if marked else b""
    if not data:
        return lead
    if level > 0 and (packed := _packed(data, 1 if level == 1 else 8 * level)) is not None:
        return lead + packed
    return lead + b"\0" + data


def _packed(data: bytes, tries: int) -> bytes | None:
    out, places, n = bytearray(put_varint(len(data))), {}, len(data)
    at = start = 0
    last = 1
    while at + 4 <= n:
        word = data[at : at + 4]
        seen = places.get(word)
        best = source = 0
        if at and data[at - last : at - last + 4] == word and at >= last:
            best, source = _match(data, at - last, at), at - last
        for p in reversed(seen[-tries:]) if seen else ():
            if at - p > FAR:
                break
            size = _match(data, p, at)
            if size > best:
                best, source = size, p
        places.setdefault(word, []).append(at)
        if best < 4:
            at += 1
            continue
        before = data[start:at]
        if at - source == last:
            out += _literal(before) + _repeat(best)
        else:
            out += _copy(at - source, best, before)
        last = at - source
        for k in range(at + 1, min(at + best, n - 3), 1 if best < 64 else 16):
            places.setdefault(data[k : k + 4], []).append(k)
        at += best
        start = at
        if len(out) >= n:
            return None
    out += _literal(data[start:])
    return bytes(out) if len(out) < n else None


def _match(data: bytes, a: int, b: int) -> int:
    n, size = len(data), 0
    step = 32
    while b + size + step <= n and data[a + size : a + size + step] == data[b + size : b + size + step]:
        size += step
    while b + size < n and data[a + size] == data[b + size]:
        size += 1
    return size
