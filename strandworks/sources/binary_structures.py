"""Atoms from MMTF, a MessagePack map of encoded arrays, by its public specification."""

from __future__ import annotations

import struct

import numpy as np

#: Fixed values of the format: how many bytes give a length or a number, by type byte.
_NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
_SIZED = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}


def unpack(data: bytes, at: int = 0) -> tuple[object, int]:
    """The MessagePack value at a place, and where it ends; raises on other bytes."""
    kind = data[at]
    at += 1
    if kind <= 0x7F:
        return kind, at
    if kind >= 0xE0:
        return kind - 256, at
    if kind in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[kind], at
    if kind in _NUMBERS:
        form = _NUMBERS[kind]
        return struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
    if kind in _SIZED:
        what, form = _SIZED[kind]
        size, at = struct.unpack_from(form, data, at)[0], at + struct.calcsize(form)
    elif kind <= 0x8F:
        what, size = "map", kind & 15
    elif kind <= 0x9F:
        what, size = "list", kind & 15
    elif 0xA0 <= kind <= 0xBF:
        what, size = "str", kind & 31
    else:
        raise ValueError(f"no MessagePack type {kind:#x}")
    if what in ("bin", "str"):
        raw = data[at : at + size]
        if len(raw) < size:
            raise ValueError("the data end too early")
        return (raw if what == "bin" else raw.decode()), at + size
    out: list = []
    for _ in range(size * (2 if what == "map" else 1)):
        value, at = unpack(data, at)
        out.append(value)
    return (dict(zip(out[::2], out[1::2])) if what == "map" else out), at


def _pairs(x: np.ndarray) -> np.ndarray:
    return np.repeat(x[::2], x[1::2])


def _sums(x: np.ndarray, bits: int) -> np.ndarray:
    """Numbers that were split into steps of at most the type's bounds."""
    top, low = (1 << (bits - 1)) - 1, -(1 << (bits - 1))
    whole = (x != top) & (x != low)
    ends = np.flatnonzero(whole)
    return np.diff(np.concatenate([[0], np.cumsum(x.astype(np.int64))[ends]]))


def decode(field: object) -> list | np.ndarray | object:
    """An encoded array as numbers or texts; anything but bytes as it is."""
    if not isinstance(field, bytes):
        return field
    codec, _, parameter = struct.unpack_from(">iii", field)
    body = field[12:]
    as_ = lambda kind: np.frombuffer(body, kind)
    by = float(parameter or 1)
    if codec == 1:
        return as_(">f4").astype(float)
    if codec in (2, 3, 4):
        return as_({2: ">i1", 3: ">i2", 4: ">i4"}[codec]).astype(np.int64)
    if codec == 5:
        return [body[i : i + parameter].rstrip(b"\0").decode() for i in range(0, len(body), parameter)]
    if codec == 6:
        return ["" if c == 0 else chr(c) for c in _pairs(as_(">i4")).tolist()]
    if codec == 7:
        return _pairs(as_(">i4")).astype(np.int64)
    if codec == 8:
        return np.cumsum(_pairs(as_(">i4")).astype(np.int64))
    if codec == 9:
        return _pairs(as_(">i4")) / by
    if codec == 10:
        return np.cumsum(_sums(as_(">i2"), 16)) / by
    if codec == 11:
        return as_(">i2") / by
    if codec in (12, 13):
        return _sums(as_(">i2" if codec == 12 else ">i1"), 16 if codec == 12 else 8) / by
    if codec in (14, 15):
        return _sums(as_(">i2" if codec == 14 else ">i1"), 16 if codec == 14 else 8)
    raise ValueError(f"no codec {codec}")


def parse_mmtf(data: bytes, structure_id: str) -> list[tuple]:
    """Atom rows of the first model, as of :func:`strandworks.sources.structure_text.parse_mmcif`;
    atoms of chains that are no polymer are hetero."""
    held, _ = unpack(data)
    field = {k: decode(v) for k, v in held.items()}
    chains = int(field["chainsPerModel"][0]) if field.get("chainsPerModel") is not None and len(field["chainsPerModel"]) else len(field["groupsPerChain"])
    names = field.get("chainNameList") or field["chainIdList"]
    polymer = {c for e in field.get("entityList") or [] if e.get("type") == "polymer" for c in e.get("chainIndexList", [])}
    n = len(field["xCoordList"])
    alt = field.get("altLocList")
    alt = [""] * n if alt is None or not len(alt) else alt
    codes = field.get("insCodeList")
    out: list[tuple] = []
    group = 0
    for chain in range(chains):
        for _ in range(int(field["groupsPerChain"][chain])):
            kind = field["groupList"][int(field["groupTypeList"][group])]
            code = codes[group] if codes is not None and len(codes) else ""
            for name, element in zip(kind["atomNameList"], kind["elementList"]):
                i = len(out)
                xyz = (round(float(field[f"{c}CoordList"][i]), 3) for c in "xyz")
                out.append((structure_id, i, names[chain], int(field["groupIdList"][group]), code, kind["groupName"], name, element.upper(), chain not in polymer, alt[i], *xyz))
            group += 1
    return out
