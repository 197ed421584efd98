"""FITS files built byte by byte, without the code under test."""

import struct


def card(key, value=None, quote=True):
    if value is None:
        text = key
    elif isinstance(value, bool):
        text = f"{key:<8}= {'T' if value else 'F':>20}"
    elif isinstance(value, (int, float)):
        text = f"{key:<8}= {value!s:>20}"
    else:
        text = f"{key:<8}= '{value}'" if quote else f"{key:<8}= {value}"
    assert len(text) <= 80
    return text.ljust(80)


def block(data: bytes, fill: bytes = b"\0") -> bytes:
    return data + fill * (-len(data) % 2880)


def header(cards) -> bytes:
    return block("".join([*cards, "END".ljust(80)]).encode(), b" ")


def primary(extra=(), naxis=(), data=b"") -> bytes:
    cards = [card("SIMPLE", True), card("BITPIX", 8), card("NAXIS", len(naxis)), *(card(f"NAXIS{i}", n) for i, n in enumerate(naxis, 1)), *extra]
    return header(cards) + block(data)


def table(columns, rows, heap=b"", gap=0, extra=()) -> bytes:
    """columns: (name, tform, {keyword: value}); rows: bytes each."""
    width = len(rows[0]) if rows else 0
    cards = [card("XTENSION", "BINTABLE"), card("BITPIX", 8), card("NAXIS", 2), card("NAXIS1", width), card("NAXIS2", len(rows)), card("PCOUNT", len(heap) + gap), card("GCOUNT", 1), card("TFIELDS", len(columns))]
    if gap:
        cards.append(card("THEAP", width * len(rows) + gap))
    for i, (name, form, more) in enumerate(columns, 1):
        cards += [card(f"TTYPE{i}", name)] if name else []
        cards += [card(f"TFORM{i}", form)] + [card(f"{k}{i}", v) for k, v in more.items()]
    return header([*cards, *extra]) + block(b"".join(rows) + b"\xff" * gap + heap)


def pack(form, *values) -> bytes:
    return struct.pack(">" + form, *values)
