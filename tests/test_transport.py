"""Teletext through a transport stream and back."""

from pyspark.sql import functions as F

from concord.operators import pages
from concord.sources import transport


def made(raw: list[bytes], pid: int = 0x123) -> list[bytes]:
    """Payload units of four teletext packets each, cut into transport packets."""
    out, counter = [], 0
    for k in range(0, len(raw), 4):
        body = b"\x10" + b"".join(b"\x02\x2c\xe7\xe4" + transport.FLIP[list(p)].tobytes() for p in raw[k : k + 4])
        unit = b"\0\0\1\xbd" + (3 + len(body)).to_bytes(2, "big") + b"\x80\0\0" + body
        first = True
        while unit or first:
            piece, unit = unit[:184], unit[184:]
            head = bytes([0x47, (0x40 if first else 0) | pid >> 8, pid & 255])
            if len(piece) == 184:
                packet = head + bytes([0x10 | counter]) + piece
            else:
                gap = 183 - len(piece)
                packet = head + bytes([0x30 | counter, gap]) + (b"\0" + b"\xff" * (gap - 1) if gap else b"") + piece
            out.append(packet)
            counter, first = (counter + 1) % 16, False
    return out


def test_round_trip(spark):
    page = spark.createDataFrame([(1, 0x10, 0, r, f"row {r}".ljust(40)) for r in range(1, 8)], "magazine int, page int, subcode int, row int, text string")
    raw = [bytes(r.packet) for r in pages.to_packets(page).orderBy("seq").collect()]
    sent = made(raw)
    assert all(len(p) == 188 for p in sent)
    sent.insert(1, sent[0])  # sent twice
    sent.insert(0, b"\x47\x1f\xff\x10" + b"\xff" * 184)
    sent.append(b"\x00" * 188)
    df = spark.createDataFrame([("r", k, bytearray(p)) for k, p in enumerate(sent)], "recording string, seq long, packet binary")
    heads = transport.headers(df)
    found = transport.teletext(transport.units(heads.filter(F.col("pid") == 0x123))).orderBy("seq").collect()
    assert [bytes(r.packet) for r in found] == raw
    c = {r.pid: (r.lost, r.repeated) for r in transport.continuity(heads).collect()}
    assert c == {0x123: (0, 1), 0x1FFF: (0, 0)}
    cut = spark.createDataFrame([("r", k, bytearray(p)) for k, p in enumerate(made(raw)) if k != 1], "recording string, seq long, packet binary")
    assert transport.continuity(transport.headers(cut)).first().lost == 1
