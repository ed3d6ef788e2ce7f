"""Byte packings of TIFF: LZW (codes of 9 to 12 bits, highest bit first) and PackBits."""

from __future__ import annotations

CLEAR, END, FIRST, LAST = 256, 257, 258, 4095


def unpack_lzw(data: bytes) -> bytes:
    """Codes grow by a bit one entry early, as the format has it; a stream may lack its end code."""
    if data[:1] == b"\0" and len(data) > 1 and data[1] & 1:
        raise NotImplementedError("LZW with the lowest bit first (before TIFF 5)")
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out = start.copy(), []
    width, held, bits, last = 9, 0, 0, b""
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == CLEAR:
            table, width, last = start.copy(), 9, b""
            continue
        if code == END:
            break
        if not last:
            last = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            last = entry
        out.append(last)
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def pack_lzw(data: bytes) -> bytes:
    out, held, bits = bytearray(), 0, 0
    codes: dict[bytes, int] = {}
    width, following = 9, FIRST

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    put(CLEAR)
    run = b""
    for i in range(len(data)):
        longer = run + data[i : i + 1]
        if len(longer) == 1 or longer in codes:
            run = longer
            continue
        put(codes[run] if len(run) > 1 else run[0])
        codes[longer] = following
        following += 1
        if following == LAST:
            put(CLEAR)
            codes, width, following = {}, 9, FIRST
        elif following + 1 > 1 << width:
            width += 1
        run = data[i : i + 1]
    if run:
        put(codes[run] if len(run) > 1 else run[0])
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpack_bits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)
