import random

import pytest

from anontext.llm import similar_dedup as sd
from anontext.llm.fingerprint_dedup import fingerprint
from tests.llm.test_fingerprint_dedup import groups


def jaccard(a, b):
    def made(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    a, b = made(a), made(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus(words, seed):
    """Texts with copies that differ in a few words, on both sides of the threshold."""
    r, texts = random.Random(seed), []
    for g in range(25):
        w = words(r.choice([6, 40, 150, 400]), seed * 1000 + g)
        texts.append(" ".join(w))
        for _ in range(r.randint(1, 4)):
            own = w[:]
            for _ in range(r.randint(1, max(1, len(w) // 30))):
                own[r.randrange(len(own))] = "zz" + str(r.random())
            texts.append(" ".join(own))
    return [*texts, texts[0].upper(), "", None, " \n", "one two", "one two three", "ONE two"]


@pytest.mark.parametrize("centres", [0, 2])
def test_stage_links_by_five_word_jaccard(spark, make, words, monkeypatch, centres):
    from corpus_pipeline import drop_near_duplicates

    monkeypatch.setattr(sd, "CENTRES", centres)
    texts = corpus(words, 1)
    root = groups(range(len(texts)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    assert 20 < len(set(root.values())) < len(texts) - 10
    # Some of these copies lie further apart than the two bits of op6.
    near = [(a, b) for a in root for b in root if a < b and jaccard(texts[a], texts[b]) >= 0.8]
    fps = [fingerprint((t or "").encode().lower().split(), 3) for t in texts]
    assert any((fps[a] ^ fps[b]).bit_count() > 2 for a, b in near)
    got = drop_near_duplicates(spark, make(texts), None)
    assert len(got.columns) == 16
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(root.values()))


def test_bands_propose_every_similar_pair(words):
    missed = near = dropped = 0
    for seed in range(12):
        texts = corpus(words, seed)
        sketched = [sd.sketch((t or "").encode()) for t in texts]
        made = [set(enumerate(s[2])) for s in sketched]
        for a in range(len(texts)):
            for b in range(a):
                if texts[a] and texts[b] and jaccard(texts[a], texts[b]) >= 0.8:
                    near += 1
                    missed += not made[a] & made[b] and texts[a].split() != texts[b].split()
                    dropped += sum(x == y for x, y in zip(sketched[a][3], sketched[b][3])) < sd.LEAST
    assert near > 150 and missed == dropped == 0


def test_nulls_repeats_and_empty_tables(make):
    rows = [(None, "a b c"), (4, "a b c"), (4, "a b c"), (2, None), (None, None), (None, "q r s t")]
    assert sorted(((r.doc_id, r.text) for r in sd.keep_one(make(rows)).collect()), key=str) == sorted(
        [(4, "a b c"), (2, None), (None, "q r s t")], key=str)
    assert sd.keep_one(make([])).count() == 0


def test_copies_are_proposed_by_fingerprints_and_decided_on_texts(make, words, monkeypatch):
    long = words(3000, 5)
    texts = corpus(words, 3) + [" ".join([*long[:i * 300], f"zz{i}", *long[i * 300:]]) for i in range(8)]
    fps = [fingerprint((t or "").encode().lower().split(), 3) for t in texts]
    marked = sd.sketches(make(texts).select("doc_id", "text")).cache()
    assert [r._print % (1 << 64) for r in marked.orderBy("doc_id").collect()] == fps
    distinct = marked.drop("doc_id").dropDuplicates(["_fp"])
    ids = {r._fp: r.doc_id for r in marked.collect()}
    pairs = [(ids[r.a], ids[r.b]) for r in sd.printed_pairs(distinct).collect()]
    want = groups([i for i in set(ids.values()) if texts[i] and texts[i].split()], lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2)
    got = groups(want, lambda a, b: (a, b) in pairs or (b, a) in pairs)
    assert len(pairs) >= 3 and got == want
    seen = []
    near = sd.near_prints
    monkeypatch.setattr(sd, "near_prints", lambda fps: seen.append(1) or near(fps))
    root = groups(range(len(texts)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    assert sorted(r.doc_id for r in sd.keep_one(make(texts)).collect()) == sorted(set(root.values())) and seen


def test_copies_that_cannot_be_similar_are_not_paired(spark, make, words, monkeypatch):
    """Far copies of one text share bands, but not enough shingles: they meet no more than a few times a text; near ones all meet."""
    from corpus_pipeline import drop_near_duplicates

    monkeypatch.setattr(sd, "CENTRES", 0)
    r, base, texts = random.Random(4), words(200, 77), []
    for i in range(60):
        own = base[:]
        for at in r.sample(range(200), 7):  # 35 of 196 shingles: 0.70 at most between the text and a copy
            own[at] = f"zz{i}x{at}"
        texts.append(" ".join(own))
    own[own.index(next(w for w in own if not w.startswith("zz")))] = "yy"
    texts.append(" ".join(own))  # of the last copy
    seen, likely = [], sd.likely
    monkeypatch.setattr(sd, "likely", lambda pairs, d: seen.append(pairs.count()) or likely(pairs, d))
    root = groups(range(len(texts)), lambda a, b: jaccard(texts[a], texts[b]) >= 0.8)
    assert len(set(root.values())) == 60
    assert sorted(x.doc_id for x in drop_near_duplicates(spark, make(texts), None).collect()) == sorted(set(root.values()))
    assert 1 <= sum(seen) <= len(texts)


def test_rarest_shared_shingles_lose_no_similar_pair(spark, words):
    """Against all pairs, with texts of one root and of many, and a passage in very many texts."""
    for seed in (5, 6):
        texts = sorted({t.lower() for t in corpus(words, seed) if t and t.split()})
        texts += [" ".join(words(30, 8) + words(40, 900 + i)) for i in range(20)]
        made = [sd._hashes(t.encode().lower().split(), 5) for t in texts]
        root = [i if i % 3 else i // 9 for i in range(len(texts))]
        members = spark.createDataFrame([(i, len(h), root[i]) for i, h in enumerate(made)], "_fp long, _n long, _root long")
        held = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "_fp long, _text binary")
        got = {tuple(sorted((x._fp, x._c))) for x in sd.rare_pairs(members, lambda ids: held.join(ids, "_fp"), 5, 0.8).collect()}
        want = {(a, b) for b in range(len(texts)) for a in range(b) if root[a] != root[b] and jaccard(texts[a], texts[b]) >= 0.8}
        assert want and want <= got and all(root[a] != root[b] for a, b in got)


def test_texts_beside_a_large_group_of_copies_meet_few_of_it(spark, words):
    """Copies of one text: those far off it are compared with the few of the group that they may be similar to."""
    r, base, texts = random.Random(8), words(150, 70), []
    for i in range(80):
        own = base[:]
        for at in r.sample(range(0, 150, 6), 1 + i % 2 if i < 60 else 3):  # 5 of 146 shingles each
            own[at] = f"zz{i}x{at}"
        texts.append(" ".join(own))
    made = [sd._hashes(t.encode().split(), 5) for t in texts]
    root = [0 if i < 60 else i for i in range(80)]
    members = spark.createDataFrame([(i, len(h), root[i]) for i, h in enumerate(made)], "_fp long, _n long, _root long")
    held = spark.createDataFrame([(i, t.encode()) for i, t in enumerate(texts)], "_fp long, _text binary")
    got = [tuple(sorted((x._fp, x._c))) for x in sd.rare_pairs(members, lambda ids: held.join(ids, "_fp"), 5, 0.8).collect()]
    want = {(a, b) for b in range(80) for a in range(b) if root[a] != root[b] and jaccard(texts[a], texts[b]) >= 0.8}
    assert want and want <= set(got) and len(set(got)) < 2 * len(want)


def test_sketch_hashes_each_shingle_once(words, monkeypatch):
    """Minima and fingerprint come from one hash of each three words."""
    taken, digest = [], sd.xxhash.xxh64_intdigest
    monkeypatch.setattr(sd.xxhash, "xxh64_intdigest", lambda *a: taken.append(1) or digest(*a))
    for n in (1, 4, 5, 300, 3000):
        own = [w.encode() for w in words(n, n)] + [b"a", b"b"] * (n // 100)
        taken.clear()
        got = sd.sketch(b" ".join(own))
        assert len(taken) <= len(own) + sd.BANDS + 2
        assert got[1] == len(sd._hashes(own, 5)) == len({tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))})
        assert got[4] == fingerprint(own, 3)
