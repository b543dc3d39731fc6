import gzip
import struct

import numpy as np
import pytest

from strandworks.sources.binary_structures import decode, parse_mmtf, unpack
from strandworks.sources.structure_text import read_structures


def pack(x) -> bytes:
    if x is None or isinstance(x, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[x]
    if isinstance(x, int):
        return struct.pack("b", x) if -32 <= x < 128 else b"\xd2" + struct.pack(">i", x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        raw = x.encode()
        return (bytes([0xA0 | len(raw)]) if len(raw) < 32 else b"\xda" + struct.pack(">H", len(raw))) + raw
    if isinstance(x, bytes):
        return b"\xc6" + struct.pack(">I", len(x)) + x
    if isinstance(x, dict):
        return b"\xde" + struct.pack(">H", len(x)) + b"".join(pack(k) + pack(v) for k, v in x.items())
    return (bytes([0x90 | len(x)]) if len(x) < 16 else b"\xdd" + struct.pack(">I", len(x))) + b"".join(map(pack, x))


def field(codec, n, parameter, body):
    return struct.pack(">iii", codec, n, parameter) + bytes(body)


def ints(kind, values):
    return np.array(values, kind).tobytes()


def steps(values, bits):
    top, low = (1 << (bits - 1)) - 1, -(1 << (bits - 1))
    out = []
    for v in values:
        while v >= top or v <= low:
            out.append(top if v >= top else low)
            v -= out[-1]
        out.append(v)
    return out


def test_values():
    for x in (0, 127, -1, -32, 300, -70000, 1.5, "a", "b" * 40, b"\0\1", None, True, [1, [2, "x"]], list(range(20)), {"k": {"l": [None]}}):
        assert unpack(pack(x)) == (x, len(pack(x)))
    with pytest.raises(ValueError):
        unpack(b"\xc1")


@pytest.mark.parametrize(
    ("encoded", "want"),
    [
        (field(1, 2, 0, ints(">f4", [1.5, -2])), [1.5, -2]),
        (field(2, 2, 0, ints(">i1", [1, -2])), [1, -2]),
        (field(4, 1, 0, ints(">i4", [70000])), [70000]),
        (field(5, 2, 4, b"A\0\0\0BCD\0"), ["A", "BCD"]),
        (field(6, 3, 0, ints(">i4", [65, 2, 0, 1])), ["A", "A", ""]),
        (field(7, 3, 0, ints(">i4", [5, 2, 7, 1])), [5, 5, 7]),
        (field(8, 4, 0, ints(">i4", [1, 3, 5, 1])), [1, 2, 3, 8]),
        (field(9, 3, 100, ints(">i4", [150, 3])), [1.5, 1.5, 1.5]),
        (field(10, 3, 1000, ints(">i2", steps([40000, -80000, 5], 16))), [40.0, -40.0, -39.995]),
        (field(11, 2, 10, ints(">i2", [15, -7])), [1.5, -0.7]),
        (field(12, 2, 10, ints(">i2", steps([32767, -32768], 16))), [3276.7, -3276.8]),
        (field(13, 3, 10, ints(">i1", steps([127, -128, 300], 8))), [12.7, -12.8, 30.0]),
        (field(14, 2, 0, ints(">i2", steps([100000, 3], 16))), [100000, 3]),
        (field(15, 2, 0, ints(">i1", steps([-300, 3], 8))), [-300, 3]),
    ],
)
def test_codecs(encoded, want):
    got = decode(encoded)
    assert list(got) == pytest.approx(want) if not isinstance(want[0], str) else got == want


def example() -> bytes:
    xyz = [[1.0, 2.5, -3.125], [0.5, 60.0, -70.25], [9.0, 8.0, 7.0], [0.0, 0.0, 0.001]]
    delta = lambda k: field(10, 4, 1000, ints(">i2", steps(np.diff([0, *[round(p[k] * 1000) for p in xyz]]).tolist(), 16)))
    groups = [{"groupName": "GLY", "atomNameList": ["N", "CA", "C"], "elementList": ["N", "C", "C"]}, {"groupName": "ZN", "atomNameList": ["ZN"], "elementList": ["Zn"]}]
    return pack(
        {
            "xCoordList": delta(0), "yCoordList": delta(1), "zCoordList": delta(2), "groupList": groups, "groupTypeList": field(4, 2, 0, ints(">i4", [0, 1])),
            "groupIdList": field(8, 2, 0, ints(">i4", [7, 1, 93, 1])), "insCodeList": field(6, 2, 0, ints(">i4", [65, 1, 0, 1])), "altLocList": field(6, 4, 0, ints(">i4", [0, 4])),
            "chainIdList": field(5, 2, 4, b"A\0\0\0B\0\0\0"), "chainNameList": field(5, 2, 4, b"X\0\0\0X\0\0\0"), "groupsPerChain": [1, 1], "chainsPerModel": [2],
            "entityList": [{"type": "polymer", "chainIndexList": [0]}, {"type": "non-polymer", "chainIndexList": [1]}],
        }
    )


def test_atoms_and_files(spark, tmp_path):
    rows = parse_mmtf(example(), "1abc")
    assert rows[1] == ("1abc", 1, "X", 7, "A", "GLY", "CA", "C", False, "", 0.5, 60.0, -70.25)
    assert rows[3] == ("1abc", 3, "X", 100, "", "ZN", "ZN", "ZN", True, "", 0.0, 0.0, 0.001)
    (tmp_path / "1abc.mmtf").write_bytes(example())
    (tmp_path / "2abc.mmtf.gz").write_bytes(gzip.compress(example()))
    (tmp_path / "bad.mmtf").write_bytes(b"\xc1no")
    got = read_structures(spark, f"file://{tmp_path}").collect()
    assert sorted(tuple(r) for r in got) == sorted(rows + parse_mmtf(example(), "2abc"))
