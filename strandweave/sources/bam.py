"""BAM as rows: gzip blocks of little-endian records, as the published format describes them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import IO

from strandweave.sources.sam import typed_tags
from strandweave.sources.text import open_bytes

#: The letters of bases and CIGAR operations by number, the types of numeric tags, the end of a file.
BASES = "=ACMGRSVTWYHKDBN"
OPERATIONS = "MIDNSHP=X"
NUMBERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
_FIXED = struct.Struct("<iiBBHHHiiii")
_BLOCK = 0xFF00


def _take(f: IO[bytes], n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise EOFError
    return data


def read_header(f: IO[bytes]) -> tuple[str, list[str]]:
    """Header text and names of the references."""
    if _take(f, 4) != b"BAM\1":
        raise ValueError("not a BAM file")
    text = _take(f, struct.unpack("<i", _take(f, 4))[0]).rstrip(b"\0").decode()
    names = []
    for _ in range(struct.unpack("<i", _take(f, 4))[0]):
        names.append(_take(f, struct.unpack("<i", _take(f, 4))[0])[:-1].decode())
        _take(f, 4)
    return text, names


def header_of(path: str) -> str:
    """The header lines."""
    with open_bytes(path) as f:
        return read_header(f)[0].rstrip("\n")


def _tags(data: bytes) -> tuple[dict[str, str], dict[str, str]]:
    tags, types, at = {}, {}, 0
    while at < len(data):
        name, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind == "B":
            inner, (n,) = chr(data[at]), struct.unpack_from("<i", data, at + 1)
            form = f"<{n}{NUMBERS[inner]}"
            value, at = ",".join([inner, *map(str, struct.unpack_from(form, data, at + 5))]), at + 5 + struct.calcsize(form)
        else:
            form = "<" + NUMBERS[kind]
            value, at = str(struct.unpack_from(form, data, at)[0]), at + struct.calcsize(form)
            kind = kind if kind == "f" else "i"
        tags[name], types[name] = value, kind
    return tags, types


def rows(path: str) -> Iterator[tuple]:
    """The records in file order."""
    with open_bytes(path) as f:
        _, names = read_header(f)
        name_of = lambda i: names[i] if i >= 0 else "*"
        index = 0
        while head := f.read(4):
            data = _take(f, struct.unpack("<i", head)[0])
            ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, mate_pos, tlen = _FIXED.unpack_from(data)
            at = _FIXED.size
            name, at = data[at : at + l_name - 1].decode(), at + l_name
            operations = struct.unpack_from(f"<{n_cigar}I", data, at)
            at += 4 * n_cigar
            packed, at = data[at : at + (l_seq + 1) // 2], at + (l_seq + 1) // 2
            seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
            qual, at = data[at : at + l_seq], at + l_seq
            tags, types = _tags(data[at:])
            cigar = "".join(f"{o >> 4}{OPERATIONS[o & 15]}" for o in operations) or "*"
            text = "*" if not qual or qual[0] == 0xFF else "".join(chr(q + 33) for q in qual)
            other = "=" if mate == ref and mate >= 0 else name_of(mate)
            yield (path, index, name, flag, name_of(ref), pos + 1, mapq, cigar, other, mate_pos + 1, tlen, seq or "*", text, tags, types)
            index += 1


def _bin(start: int, end: int) -> int:
    """The number of the smallest index bin that holds a range."""
    end -= 1
    for shift, offset in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if start >> shift == end >> shift:
            return offset + (start >> shift)
    return 0


def _packed_tags(row) -> bytes:
    out = []
    for name, kind, value in typed_tags(row):
        head = name.encode() + kind.encode()
        if kind in "ZH":
            out.append(head + value.encode() + b"\0")
        elif kind == "A":
            out.append(head + value.encode()[:1])
        elif kind == "B":
            inner, *numbers = value.split(",")
            cast = float if inner == "f" else int
            out.append(head + inner.encode() + struct.pack(f"<i{len(numbers)}{NUMBERS[inner]}", len(numbers), *map(cast, numbers)))
        elif kind == "f":
            out.append(head + struct.pack("<f", float(value)))
        else:
            number = int(value)
            out.append(name.encode() + (b"I" + struct.pack("<I", number) if number > 0x7FFFFFFF else b"i" + struct.pack("<i", number)))
    return b"".join(out)


def _record(row, numbers: dict[str, int]) -> bytes:
    cigar, operations, span, digits = row["cigar"], [], 0, ""
    for c in "" if cigar == "*" else cigar:
        if c.isdigit():
            digits += c
        else:
            operations.append(int(digits) << 4 | OPERATIONS.index(c))
            span += int(digits) if c in "MDN=X" else 0
            digits = ""
    seq = "" if row["seq"] == "*" else row["seq"].upper()
    codes = [BASES.find(b) if b in BASES else 15 for b in seq] + [0] * (len(seq) % 2)
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(codes), 2))
    qual = b"\xff" * len(seq) if row["qual"] == "*" else bytes(ord(q) - 33 for q in row["qual"])
    ref = numbers.get(row["rname"], -1)
    mate = ref if row["rnext"] == "=" else numbers.get(row["rnext"], -1)
    pos, name = row["pos"] - 1, row["qname"].encode() + b"\0"
    number = 4680 if pos < 0 else _bin(pos, pos + max(span, 1))
    fixed = _FIXED.pack(ref, pos, len(name), row["mapq"], number, len(operations), row["flag"], len(seq), mate, row["pnext"] - 1, row["tlen"])
    body = fixed + name + struct.pack(f"<{len(operations)}I", *operations) + packed + qual + _packed_tags(row)
    return struct.pack("<i", len(body)) + body


def _block(data: bytes) -> bytes:
    """A gzip member that says its own size."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<HBBHH", 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def dump(path: str, header: str, records: Iterator) -> None:
    """Write a BAM file; the references are those of the header's @SQ lines."""
    refs = [dict(x.split(":", 1) for x in line.split("\t")[1:]) for line in header.splitlines() if line.startswith("@SQ")]
    numbers = {r["SN"]: i for i, r in enumerate(refs)}
    text = (header.rstrip("\n") + "\n").encode()
    start = b"BAM\1" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(refs))
    for r in refs:
        name = r["SN"].encode() + b"\0"
        start += struct.pack("<i", len(name)) + name + struct.pack("<i", int(r["LN"]))
    with open(path, "wb") as f:
        waiting = bytearray(start)
        for row in records:
            waiting += _record(row, numbers)
            while len(waiting) >= _BLOCK:
                f.write(_block(bytes(waiting[:_BLOCK])))
                del waiting[:_BLOCK]
        if waiting:
            f.write(_block(bytes(waiting)))
        f.write(END)
