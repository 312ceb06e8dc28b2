"""An incremental UTF-8 state machine."""

ACCEPT, REJECT = 0, -1


def _machine() -> list[list[int]]:
    """Next state by state and byte. State 0 stands between characters; the others wait for
    one, two or three more bytes, the second byte of some leads being narrower."""
    one, two, three, after_e0, after_ed, after_f0, after_f4 = range(1, 8)
    table = [[REJECT] * 256 for _ in range(8)]

    def allow(state: int, low: int, high: int, to: int) -> None:
        table[state][low:high + 1] = [to] * (high + 1 - low)

    allow(ACCEPT, 0x00, 0x7F, ACCEPT)
    allow(ACCEPT, 0xC2, 0xDF, one)
    allow(ACCEPT, 0xE1, 0xEF, two)
    allow(ACCEPT, 0xE0, 0xE0, after_e0)
    allow(ACCEPT, 0xED, 0xED, after_ed)
    allow(ACCEPT, 0xF1, 0xF3, three)
    allow(ACCEPT, 0xF0, 0xF0, after_f0)
    allow(ACCEPT, 0xF4, 0xF4, after_f4)
    allow(one, 0x80, 0xBF, ACCEPT)
    allow(two, 0x80, 0xBF, one)
    allow(three, 0x80, 0xBF, two)
    allow(after_e0, 0xA0, 0xBF, one)
    allow(after_ed, 0x80, 0x9F, one)
    allow(after_f0, 0x90, 0xBF, two)
    allow(after_f4, 0x80, 0x8F, two)
    return table


MACHINE = _machine()
REPLACEMENT = "�"


def feed(pending: bytes, piece: bytes) -> tuple[str, bytes]:
    """(text, pending) after ``piece``; ``pending`` is an unfinished character.

    Bytes that no character can contain become U+FFFD, one for each longest
    unfinished character, as in the Unicode standard's recommended practice.
    """
    data, state, begun, out = pending + piece, ACCEPT, 0, []
    at = 0
    while at < len(data):
        after = MACHINE[state][data[at]]
        if after == REJECT:
            out.append(REPLACEMENT)
            at += at == begun  # the byte that broke a character is read again
            begun, state = at, ACCEPT
            continue
        at += 1
        state = after
        if state == ACCEPT:
            out.append(data[begun:at].decode())
            begun = at
    return "".join(out), data[begun:]


def close(pending: bytes) -> str:
    """What an unfinished character at the end of the stream becomes."""
    return REPLACEMENT if pending else ""
