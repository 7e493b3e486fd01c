"""Cross-tokenizer alignment (op13) against a plain version."""

import hashlib
from collections import Counter, defaultdict

import pytest

from lakeweave.llm import alignment


def plain(texts):
    """Rows as the contract says, from the tokenizers' own libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.vocabulary_paths()
    one, two = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    one.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in printable}
    letter |= {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in printable)}

    def piece(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    found, pairs = [], Counter()
    for t in texts:
        t = t or ""
        a, b = one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)
        size = [[bytes(letter[c] for c in one.id_to_token(i)) for i in a], [piece(i) for i in b]]
        if not t or any(b"".join(x) != (" " + t).encode() for x in size):
            found.append(None)
            continue
        ends = [[], []]
        for side in (0, 1):
            at = 0
            for x in size[side]:
                at += len(x)
                ends[side].append(at)
        links, parts, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0].index(end, i), ends[1].index(end, j)
            links.append((a[x], b[y]))
            parts.append(",".join(map(str, a[i : x + 1])) + "|" + ",".join(map(str, b[j : y + 1])))
            i, j = x + 1, y + 1
        pairs.update(links)
        found.append((len(a), len(b), links, hashlib.sha256(";".join(parts).encode()).hexdigest()))
    top = defaultdict(int)
    for (_, y), n in pairs.items():
        top[y] = max(top[y], n)
    rows = []
    for f in found:
        if f is None:
            rows.append((0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, links, digest = f
            best = sum(pairs[x] == top[x[1]] for x in links)
            rows.append((n_a, n_b, len(links), len(links), best, sum(pairs[x] for x in links), digest))
    return rows


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def same_rows(df, ids, texts):
    got = sorted(map(repr, (tuple(r[c] for c in COLUMNS) for r in df.collect())))
    assert got == sorted(repr((i, *row)) for i, row in zip(ids, plain(texts)))


@pytest.mark.parametrize("held", [alignment.HELD, 20, 0])
def test_awkward_texts(spark, documents, texts, held):
    """Whatever part of the pairs every task holds, down to none."""
    more = [(20, "a ▁ b"), (21, "▁"), (22, " x"), (23, "x" * 400), (24, "<0x41> \x00 \u0001 é <s> </s> <unk> <|endoftext|>")]
    rows = documents.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    every = texts + more
    same_rows(alignment.aligned_counts(rows, held=held), [i for i, _ in every], [t for _, t in every])


def test_tables(spark, sf_dir, empty):
    assert alignment.aligned_counts(empty).count() == 0
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    from lakeweave.llm.queries import QUERIES

    same_rows(QUERIES["op13_tokenizer_alignment"](spark, sf_dir), [r.doc_id for r in rows], [r.text for r in rows])


def test_identity_map():
    v = alignment.vocabularies(*alignment.vocabulary_paths())
    known = v.same >= 0
    assert known.sum() > 10_000
    assert all(v.a[i] == v.b[v.same[i]] for i in known.nonzero()[0])
