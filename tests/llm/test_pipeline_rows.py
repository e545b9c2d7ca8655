"""The rows of the whole pipeline against a plain Python version, with null, shared and repeated ids."""

import collections
import hashlib
import math
import random
import re

import numpy as np

import corpus_pipeline
from reportloom.llm.queries import tokenizer_path

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def first_of(rows, key, order):
    groups = collections.defaultdict(list)
    for row in rows:
        groups[key(row)].append(row)
    return [min(group, key=order) for group in groups.values()]


def unlinked(rows):
    """One row of each component of shingle sets with a similarity of 0.8: of the smallest id, null last."""
    sets = []
    for row in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(row[1]))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root = [root[j] if r == root[i] else r for r in root]
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0)
    return [rows[i] for i in first_of(range(len(rows)), root.__getitem__, order)]


def mixed(rows):
    size = collections.Counter()
    for row in rows:
        size[row[3]] += len((row[1] or "").encode()) + 1
    roots = sum(s**0.5 for s in size.values())
    for row in rows:
        rate = size[row[3]] ** 0.5 / roots * sum(size.values()) / size[row[3]]
        draws = max(1, math.ceil(rate / 16))
        for draw in range(1, draws + 1):
            name = "null" if row[0] is None else row[0]
            u = int(hashlib.md5(f"10|{name}|{draw}".encode()).hexdigest()[:13], 16) / 2**52
            mean, k = rate / draws, 0
            weight = below = math.exp(-mean)
            while below <= u:
                k += 1
                weight *= mean / k
                below += weight
            yield from [row] * k


def test_rows_equal_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(9)
    words = ["the", "house", "of", "stone", "is", "far", "from", "water", "and", "light", "garden", "in", "it", "walks"]
    texts = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i] + " more") for i in range(6)]
    rows += [(None, texts[0].upper()), (None, "alone without an id"), (None, "123 !"), (None, None), (200, texts[1].title())]
    rows += [(7, "another text under the id seven"), (8, texts[9]), (300, "said twice by one id"), (300, "said twice by one id")]
    rows += [(301, "12"), (301, "letters under an id without letters elsewhere"), (None, texts[2] + " indeed")]
    rows = [(i, t, "en", f"src{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    rows = [r for r in rows if any(map(str.isalpha, r[1] or ""))]
    rows = first_of(rows, lambda r: lower(r[1]), lambda r: -1 * (-1 if r[0] is None else r[0]))
    rows = unlinked(rows)
    library = Tokenizer.from_file(tokenizer_path())
    want = collections.Counter()
    for row in mixed(rows):
        ids = library.encode(row[1], add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[row[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), tuple(ids)] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, tuple(r.ids)) for r in got) == want
    assert len(want) > 15 and {None, 7, 301} & {k[0] for k in want}
