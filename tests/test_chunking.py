import random

from hypothesis import given, settings, strategies as st

from heddle.operators import chunking


def by_hand(text, most, overlap, count):
    """The rule taken line by line, for comparison."""
    rest, chunks, block, fresh = list(enumerate(text.split("\n"), 1)), [], [], 0
    if count(text) <= most:
        return [(text, 1, len(rest))]

    def close():
        if block:
            chunks.append(("\n".join(x for _, x in block).rstrip("\n"), block[0][0], block[-1][0]))

    room = most
    while rest:
        number, line = rest[0]
        size = count(line + "\n")
        if size > most:
            close()
            block, room = [], most
            width = max(100, int(most * len(line) / max(count(line), 1) * 0.9))
            chunks += [(line[k : k + width], number, number) for k in range(0, len(line), width)]
            rest.pop(0)
        elif size <= room or fresh:
            block.append(rest.pop(0))
            room, fresh = room - size, 0
        else:
            close()
            keep, left = [], overlap
            while block and overlap > 0 and count(block[-1][1] + "\n") <= left:
                left -= count(block[-1][1] + "\n")
                keep.insert(0, block.pop())
            block, fresh = keep, 1
            room = most - (count("".join(x + "\n" for _, x in keep)) if keep else 0)
    close()
    return chunks


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=40), st.integers(5, 30), st.integers(0, 12))
def test_token_chunks_follow_the_rule(lengths, most, overlap):
    text = "\n".join("x" * n for n in lengths)
    assert chunking.chunk_tokens(text, most, overlap, len) == by_hand(text, most, overlap, len)


def test_overlong_lines_stand_alone():
    rnd = random.Random(3)
    text = "\n".join("w" * rnd.choice([3, 20, 900]) for _ in range(60))
    assert chunking.chunk_tokens(text, 40, 10) == by_hand(text, 40, 10, chunking.estimate)
    assert chunking.chunk_tokens("", 10, 2) == [("", 1, 1)]
