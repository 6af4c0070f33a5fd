import random

import pytest

from starmill.functions import tokenizer as tk
from starmill.sources.raw import _classes, raw_records


def brute(data: bytes):
    table, cls = tk.stream_table(), _classes(",")
    state, begin, out = tk.START, 0, []
    for k, c in enumerate(data):
        if c == 10 and state != tk.QUOTED:
            out.append((begin, data[begin:k].decode()))
            begin = k + 1
        state = table[state, cls[c]]
    if begin < len(data):
        out.append((begin, data[begin:].decode()))
    return out


@pytest.mark.parametrize("chunk", [7, 64, 1 << 20])
def test_records_across_chunks(spark, tmp_path, chunk):
    r = random.Random(chunk)
    texts = ["", "a\n", '"open to the end\nx,y\n', 'a,"b\nc",d\n"x ""q""\n\n y",z\n\nlast', 'bad"quote,\n"a" b,c\nok,1\n']
    texts += ["".join(r.choice(['"', '"', ",", "\n", "ab", " ", "é"]) for _ in range(r.randrange(1, 200))) for _ in range(12)]
    paths = []
    for k, t in enumerate(texts):
        p = tmp_path / f"{k}.csv"
        p.write_bytes(t.encode())
        paths.append(str(p))
    got = {p: [] for p in paths}
    for row in raw_records(spark, paths, chunk_bytes=chunk).collect():
        got[row.path].append((row.at, row.record))
    # a chunk of 7 bytes may cut a letter in two, records come whole all the same
    assert {p: sorted(v) for p, v in got.items()} == {p: brute(t.encode()) for p, t in zip(paths, texts)}
    assert raw_records(spark, paths[:1]).collect() == []
