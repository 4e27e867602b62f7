import random
import sys
import tracemalloc

from weirflow.llm import common, packing


def test_memory_is_bounded_by_bytes_and_long_words_pass():
    memory, asked = common.Memory(most_bytes=20_000), []

    def learn(words):
        asked.extend(words)
        return [w.encode() for w in words]

    draw = random.Random(1)
    for batch in range(40):
        words = {f"w{draw.randint(0, 200)}" for _ in range(30)} | {f"{batch}-{i}" * 200 for i in range(3)}
        known = memory.recall(words, learn)
        assert all(known[w] == w.encode() for w in words)
        assert sum(len(w) > 250 for w in known) == 3  # those of this batch alone
        held = sum(sys.getsizeof(w) + sys.getsizeof(v) + common._ENTRY_BYTES for w, v in known.items() if len(w) < 250)
        assert held < 20_000 + 40 * 300
    assert len(asked) > len(set(asked))  # it was begun anew in between
    assert memory.recall([], learn) is not None


def test_words_of_4000_characters_stay_small():
    draw = random.Random(2)
    tracemalloc.start()
    for _ in range(20):  # 2 MB of text each, not plain, so chunk by chunk
        packing.encode([" ".join("日" + "".join(draw.choices("abcdefgh", k=200)) * 20 for _ in range(100)) for _ in range(5)])
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert now < 40 << 20 and peak < 200 << 20, (now, peak)
