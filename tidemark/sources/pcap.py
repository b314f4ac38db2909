"""Packet captures: a Python data source for classic and next-generation capture files.

``spark.read.format("packets").load(path)`` gives one row a TCP or UDP packet.
Each file is a partition. Truncated files give the packets before the cut.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = """capture string, idx long, ts double, length int, ip_version int, proto string, src_ip string, src_port int, dst_ip string, dst_port int,
tcp_flags int, payload_len int, sni string, dns_answers array<struct<ip:string,host:string>>"""
RAW, NULL_LINK, ETHERNET, SLL, SLL2 = (12, 14, 101, 228, 229), 0, 1, 113, 276


class _Bytes:
    """Reads a stream in pieces and gives exactly n bytes, or fewer at its end."""

    def __init__(self, stream):
        self.stream = stream

    def take(self, n: int) -> bytes:
        out = self.stream.read(n)
        while len(out) < n and (more := self.stream.read(n - len(out))):
            out += more
        return out


#: Longest record or block that is read; a larger one is a broken file.
MOST_BLOCK = 1 << 26


def _classic(data: _Bytes, magic: bytes) -> Iterator[tuple[float, int, int, bytes]]:
    """(ts, link type, wire length, bytes) of each record of a classic file."""
    order = "<" if magic in (b"\xd4\xc3\xb2\xa1", b"\x4d\x3c\xb2\xa1") else ">"
    tick = 1e-9 if magic in (b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d") else 1e-6
    head = data.take(20)
    if len(head) < 20:
        return
    link = struct.unpack_from(order + "I", head, 16)[0] & 0xFFFF
    while len(head := data.take(16)) == 16:
        sec, frac, caught, wire = struct.unpack(order + "IIII", head)
        if caught > MOST_BLOCK or len(frame := data.take(caught)) < caught:
            return
        yield sec + frac * tick, link, wire or caught, frame


def _options(data: bytes, order: str) -> dict[int, bytes]:
    out, at = {}, 0
    while at + 4 <= len(data):
        code, size = struct.unpack_from(order + "HH", data, at)
        if code == 0:
            break
        out[code] = data[at + 4:at + 4 + size]
        at += 4 + size + (-size) % 4
    return out


def _next_generation(data: _Bytes, magic: bytes) -> Iterator[tuple[float, int, int, bytes]]:
    order, faces, head = "<", [], magic + data.take(4)
    while len(head) == 8:
        body = b""
        if head[:4] == b"\x0a\x0d\x0d\x0a":
            body = data.take(4)
            order, faces = ("<" if body == b"\x4d\x3c\x2b\x1a" else ">"), []
        kind, size = struct.unpack(order + "II", head)
        rest = size - 8 - len(body)
        if rest < 4 or size > MOST_BLOCK or len(more := data.take(rest)) < rest:
            return
        body = (body + more)[:-4]
        if kind == 1:
            opts = _options(body[8:], order)
            res = opts.get(9, b"\x06")[0]
            tick = 2.0 ** -(res & 0x7F) if res & 0x80 else 10.0 ** -res
            shift = struct.unpack(order + "q", opts[14])[0] if len(opts.get(14, b"")) == 8 else 0
            faces.append((struct.unpack_from(order + "H", body)[0], tick, shift))
        elif kind in (2, 6) and len(body) >= 20:
            face = struct.unpack_from(order + "I", body)[0] if kind == 6 else struct.unpack_from(order + "H", body)[0]
            high, low, caught, wire = struct.unpack_from(order + "IIII", body, 4)
            if face < len(faces):
                link, tick, shift = faces[face]
                yield (high << 32 | low) * tick + shift, link, wire or caught, body[20:20 + caught]
        head = data.take(8)


def records(stream) -> Iterator[tuple[float, int, int, bytes]]:
    """Records of a binary stream, or of bytes, one at a time."""
    data = _Bytes(io.BytesIO(stream) if isinstance(stream, bytes) else stream)
    magic = data.take(4)
    if magic == b"\x0a\x0d\x0d\x0a":
        yield from _next_generation(data, magic)
    elif magic in (b"\xd4\xc3\xb2\xa1", b"\xa1\xb2\xc3\xd4", b"\x4d\x3c\xb2\xa1", b"\xa1\xb2\x3c\x4d"):
        yield from _classic(data, magic)
    else:
        raise ValueError("not a packet capture")


def network_layer(link: int, frame: bytes) -> bytes:
    """What follows the link header; empty for other protocols."""
    if link in RAW:
        return frame
    if link == NULL_LINK:
        return frame[4:]
    if link in (SLL, SLL2):
        kind, rest = (frame[14:16], frame[16:]) if link == SLL else (frame[0:2], frame[20:])
    elif link == ETHERNET:
        at = 12
        while frame[at:at + 2] in (b"\x81\x00", b"\x88\xa8", b"\x91\x00"):
            at += 4
        kind, rest = frame[at:at + 2], frame[at + 2:]
    else:
        return b""
    return rest if kind in (b"\x08\x00", b"\x86\xdd") else b""


def _address6(raw: bytes) -> str:
    import ipaddress

    return str(ipaddress.IPv6Address(raw))


def transport(packet: bytes) -> tuple[int, int, str, str, bytes] | None:
    """(IP version, protocol, source, destination, transport bytes); None for fragments after the first and short packets."""
    if not packet:
        return None
    version = packet[0] >> 4
    if version == 4 and len(packet) >= 20:
        head = (packet[0] & 15) * 4
        total = struct.unpack_from(">H", packet, 2)[0]
        if head < 20 or struct.unpack_from(">H", packet, 6)[0] & 0x1FFF:
            return None
        return 4, packet[9], ".".join(map(str, packet[12:16])), ".".join(map(str, packet[16:20])), packet[head:total if head <= total <= len(packet) else len(packet)]
    if version == 6 and len(packet) >= 40:
        kind, at, end = packet[6], 40, 40 + struct.unpack_from(">H", packet, 4)[0]
        end = end if 40 < end <= len(packet) else len(packet)  # a jumbo or cut packet goes to its end
        for _ in range(8):
            if kind not in (0, 43, 44, 60) or at + 8 > len(packet):
                break
            size = 8 if kind == 44 else (packet[at + 1] + 1) * 8
            if kind == 44 and struct.unpack_from(">H", packet, at + 2)[0] >> 3:
                return None
            kind, at = packet[at], at + size
        return 6, kind, _address6(packet[8:24]), _address6(packet[24:40]), packet[at:end]
    return None


def server_name(payload: bytes) -> str | None:
    """The host name of a TLS ClientHello in one segment."""
    try:
        if payload[0] != 22 or payload[5] != 1:
            return None
        at = 43
        at += 1 + payload[at]
        at += 2 + struct.unpack_from(">H", payload, at)[0]
        at += 1 + payload[at]
        end = at + 2 + struct.unpack_from(">H", payload, at)[0]
        at += 2
        while at + 4 <= min(end, len(payload)):
            kind, size = struct.unpack_from(">HH", payload, at)
            if kind == 0:
                n = struct.unpack_from(">H", payload, at + 7)[0]
                name = payload[at + 9:at + 9 + n]
                return name.decode("idna").lower().rstrip(".") or None if len(name) == n else None
            at += 4 + size
    except (IndexError, struct.error, UnicodeError):
        pass
    return None


def _name(data: bytes, at: int, depth: int = 0) -> tuple[str, int]:
    parts = []
    while True:
        n = data[at]
        if n == 0:
            return ".".join(parts), at + 1
        if n & 0xC0 == 0xC0:
            if depth >= 8:
                raise ValueError("too many pointers")
            rest, _ = _name(data, (n & 0x3F) << 8 | data[at + 1], depth + 1)
            return ".".join([*parts, rest] if rest else parts), at + 2
        parts.append(data[at + 1:at + 1 + n].decode("ascii", "replace").lower())
        at += 1 + n


def dns_answers(payload: bytes) -> list[tuple[str, str]]:
    """(address, host) of the A and AAAA answers of a response."""
    out = []
    try:
        flags, asked, answered = struct.unpack_from(">HHH", payload, 2)
        if not flags & 0x8000:
            return []
        at, first = 12, None
        for _ in range(min(asked, 20)):
            name, at = _name(payload, at)
            first = first or name
            at += 4
        for _ in range(min(answered, 80)):
            name, at = _name(payload, at)
            kind, _, _, size = struct.unpack_from(">HHIH", payload, at)
            raw, at = payload[at + 10:at + 10 + size], at + 10 + size
            if kind == 1 and size == 4:
                out.append((".".join(map(str, raw)), first or name))
            elif kind == 28 and size == 16:
                out.append((_address6(raw), first or name))
    except (IndexError, struct.error, ValueError):
        pass
    return out


def packets(name: str, data, start: float | None = None, end: float | None = None) -> Iterator[tuple]:
    """Rows of SCHEMA; outside [start, end] nothing is decoded."""
    for i, (ts, link, wire, frame) in enumerate(records(data)):
        if (start is not None and ts < start) or (end is not None and ts > end):
            continue
        got = transport(network_layer(link, frame))
        if got is None or got[1] not in (6, 17) or len(got[4]) < 8:
            continue
        version, kind, src, dst, seg = got
        sport, dport = struct.unpack_from(">HH", seg)
        if kind == 6:
            head = (seg[12] >> 4) * 4 if len(seg) >= 20 else 0
            if head < 20:
                continue
            flags, payload = seg[13], seg[head:]
        else:
            told = struct.unpack_from(">H", seg, 4)[0]
            flags, payload = 0, seg[8:told if 8 <= told <= len(seg) else len(seg)]
        sni = server_name(payload) if 443 in (sport, dport) and kind == 6 else None
        yield name, i, ts, wire, version, "TCP" if kind == 6 else "UDP", src, sport, dst, dport, flags, len(payload), sni, dns_answers(payload) if 53 in (sport, dport) and kind == 17 else []


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options.get("path")
        self.start = float(options["start"]) if "start" in options else None
        self.end = float(options["end"]) if "end" in options else None

    def partitions(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path}")
        info = system.get_file_info(path)
        files = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file://"
        return [_File(scheme + f.path) for f in sorted(files, key=lambda f: f.path) if f.is_file and f.extension in ("pcap", "pcapng", "cap")]

    def read(self, partition):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_stream(path) as f:
            yield from packets(path.rpartition("/")[2], f, self.start, self.end)


class PacketSource(DataSource):
    """Format ``packets``; options path, and start and end in epoch seconds, both included."""

    @classmethod
    def name(cls):
        return "packets"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)


def register(spark) -> None:
    spark.dataSource.register(PacketSource)
