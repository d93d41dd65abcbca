"""Byte fixtures, made from the public formats: archives, images, resource tables and markup."""

from __future__ import annotations

import io
import json
import struct
import zipfile


def zip_bytes(entries: dict[str, bytes], links: dict[str, bytes] | None = None) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in entries.items():
            z.writestr(name, data)
        for name, data in (links or {}).items():
            info = zipfile.ZipInfo(name)
            info.external_attr = 0xA1FF << 16
            z.writestr(info, data)
    return out.getvalue()


def asar_bytes(tree: dict, payload: bytes = b"") -> bytes:
    text = json.dumps(tree).encode()
    padded = text + b"\0" * (-len(text) % 4)
    return struct.pack("<IIII", 4, len(padded) + 8, len(padded) + 4, len(text)) + padded + payload


def asar_of(files: dict[str, bytes]) -> bytes:
    tree: dict = {"files": {}}
    payload = b""
    for path, data in files.items():
        at = tree
        *above, leaf = path.split("/")
        for name in above:
            at = at["files"].setdefault(name, {"files": {}})
        at["files"][leaf] = {"size": len(data), "offset": str(len(payload))}
        payload += data
    return asar_bytes(tree, payload)


class _Heap:
    def __init__(self):
        self.data = b"\0"

    def add(self, text: str) -> int:
        at = len(self.data)
        self.data += text.encode() + b"\0"
        return at


def metadata_bytes(assembly: str, references: list[str], types: list[tuple[str, str, list[tuple[str, int]]]], nested: list[tuple[int, int]] = (), rich: dict[int, dict] | None = None, outside: list[tuple[str, str]] = (), files: list[str] = (), manifest: list[tuple[int, int, str, int]] = ()) -> bytes:
    """types: (namespace, name, [(method, rva)]); nested: (child row, owner row); outside: referenced types.
    rich: by type row, flags, extends (coded), fields [(name, signature, constant or None)] and shapes, by
    method name (flags, signature, parameter names).  files: names of other files; manifest: resources as
    (offset, flags, name, coded place)."""
    strings = _Heap()
    blobs = b"\0"

    def blob(data: bytes) -> int:
        nonlocal blobs
        at = len(blobs)
        blobs += bytes([len(data)]) + data
        return at

    tables: dict[int, list[bytes]] = {t: [] for t in (0, 1, 2, 4, 6, 8, 11, 32, 35, 38, 40, 41)}
    tables[0].append(struct.pack("<HHHHH", 0, strings.add("m.dll"), 0, 0, 0))
    for space, name in outside:
        tables[1].append(struct.pack("<HHH", 0, strings.add(name), strings.add(space)))
    for row, (namespace, name, methods) in enumerate(types, 1):
        more = (rich or {}).get(row, {})
        tables[2].append(struct.pack("<IHHHHH", more.get("flags", 1), strings.add(name), strings.add(namespace) if namespace else 0, more.get("extends", 0), len(tables[4]) + 1, len(tables[6]) + 1))
        for field, signature, constant in more.get("fields", []):
            tables[4].append(struct.pack("<HHH", 6, strings.add(field), blob(signature)))
            if constant is not None:
                tables[11].append(struct.pack("<HHH", constant[0], len(tables[4]) << 2, blob(constant[1])))
        for method, rva in methods:
            flags, signature, names = more.get("shapes", {}).get(method, (0x10, b"", []))
            tables[6].append(struct.pack("<IHHHHH", rva, 0, flags, strings.add(method), blob(signature) if signature else 0, len(tables[8]) + 1))
            for k, parameter in enumerate(names, 1):
                tables[8].append(struct.pack("<HHH", 0, k, strings.add(parameter)))
    tables[32].append(struct.pack("<IHHHHIHHH", 0, 1, 0, 0, 0, 0, 0, strings.add(assembly), 0))
    for r in references:
        tables[35].append(struct.pack("<HHHHIHHHH", 1, 0, 0, 0, 0, 0, strings.add(r), 0, 0))
    for name in files:
        tables[38].append(struct.pack("<IHH", 0, strings.add(name), 0))
    for offset, flags, name, coded in manifest:
        tables[40].append(struct.pack("<IIHH", offset, flags, strings.add(name), coded))
    for child, owner in nested:
        tables[41].append(struct.pack("<HH", child, owner))
    present = [t for t in sorted(tables) if tables[t]]
    valid = sum(1 << t for t in present)
    stream = struct.pack("<IBBBBQQ", 0, 2, 0, 0, 1, valid, 0) + b"".join(struct.pack("<I", len(tables[t])) for t in present) + b"".join(b"".join(tables[t]) for t in present)
    heaps = [(b"#~\0\0", stream), (b"#Strings\0\0\0\0", strings.data), (b"#Blob\0\0\0", blobs)]
    version = b"v4.0.30319\0\0"
    root = struct.pack("<IHHII", 0x424A5342, 1, 1, 0, len(version)) + version + struct.pack("<HH", 0, len(heaps))
    at = len(root) + sum(8 + len(n) for n, _ in heaps)
    body = b""
    for name, data in heaps:
        data += b"\0" * (-len(data) % 4)
        root += struct.pack("<II", at + len(body), len(data)) + name
        body += data
    return root + body


def image_bytes(imports: list[str] = (), library: bool = False, managed: dict | None = None, bodies: list[bytes] = (), sections: list[str] = (".text",), entry_token: int = 1, tail: bytes = b"") -> bytes:
    """An image of one section at address 0x1000, file offset 0x400, with imports and CLR metadata in it."""
    base, raw = 0x1000, 0x400
    section = b""

    def put(data: bytes) -> int:
        nonlocal section
        section += b"\0" * (-len(section) % 4)
        at = base + len(section)
        section += data
        return at

    directories = [(0, 0)] * 16
    rvas = [put(b) for b in bodies]
    if imports:
        names = [put(n.encode() + b"\0") for n in imports]
        directories[1] = (put(b"".join(struct.pack("<5I", 1, 0, 0, n, 1) for n in names) + bytes(20)), 20 * (len(names) + 1))
    if managed is not None:
        spec = dict(managed)
        spec["types"] = [(ns, n, [(m, rvas[b] if b is not None else 0) for m, b in ms]) for ns, n, ms in spec.get("types", [])]
        held = spec.pop("held", b"")
        data = metadata_bytes(**spec)
        meta = put(data)
        place = put(held) if held else 0
        directories[14] = (put(struct.pack("<IHHIIII", 72, 2, 5, meta, len(data), 1, entry_token) + struct.pack("<II", place, len(held)) + bytes(40)), 72)
    section += tail
    size = len(section)
    optional = struct.pack("<HBBIIIIIIIIIHHHHHHIIIIHHIIIIII", 0x10B, 0, 0, size, 0, 0, base, base, 0, 0x400000, 0x1000, 0x200, 4, 0, 0, 0, 4, 0, 0, 0x10000, raw, 0, 3, 0, 0, 0, 0, 0, 0, 16)
    optional += b"".join(struct.pack("<II", *d) for d in directories)
    coff = struct.pack("<HHIIIHH", 0x14C, len(sections), 0, 0, 0, len(optional), 0x102 | (0x2000 if library else 0))
    table = b"".join(struct.pack("<8sIIIIIIHHI", s.encode(), size, base if i == 0 else 0x90000 + i * 0x1000, size if i == 0 else 0, raw if i == 0 else 0, 0, 0, 0, 0, 0) for i, s in enumerate(sections))
    head = b"MZ" + bytes(58) + struct.pack("<I", 64) + b"PE\0\0" + coff + optional + table
    return head + bytes(raw - len(head)) + section


def packed(n: int) -> bytes:
    out = b""
    while n >= 0x80:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def text7(s: str, encoding: str = "utf-8") -> bytes:
    data = s.encode(encoding)
    return packed(len(data)) + data


def resource_bytes(entries: list[tuple[str, int, bytes]], types: list[str] = (), positions: list[int] | None = None) -> bytes:
    """entries: (name, type code, data)."""
    header = text7("System.Resources.Extensions.DeserializingResourceReader, X") + text7("Set")
    out = struct.pack("<iii", -1091581234, 1, len(header)) + header + struct.pack("<iii", 2, len(entries), len(types)) + b"".join(map(text7, types))
    out += b"\0" * (-len(out) % 8) + bytes(4 * len(entries))
    names, data, offsets = b"", b"", []
    for i, (name, code, value) in enumerate(entries):
        offsets.append(len(names))
        names += text7(name, "utf-16-le") + struct.pack("<i", len(data) if positions is None else positions[i])
        data += packed(code) + value
    out += b"".join(struct.pack("<i", o) for o in offsets)
    return out + struct.pack("<i", len(out) + 4 + len(names)) + names + data


def record(kind: int, payload: bytes = b"", variable: bool = False) -> bytes:
    return bytes([kind]) + (packed(len(payload) + 1) if variable else b"") + payload


def markup_bytes(*records: bytes, version: tuple[int, int] = (0, 96)) -> bytes:
    return struct.pack("<i", 12) + "MSBAML".encode("utf-16-le") + struct.pack("<hh", *version) * 3 + b"".join(records)
