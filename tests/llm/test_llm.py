"""The corpus operators against brute force, round trips, held-out accuracy, and odd inputs."""

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import ann, decontam, graph, langid, line_dedup, packing, passage_dedup, pii, simhash, token_store, toxicity
from sluice.llm.queries import tokenizer_path
from sluice.llm.tokens import word_ids

DOCS = "doc_id long, text string, extra string, n_words long, kept_text string"


def docs(spark, texts):
    """Rows with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(k, t, "x", 7, "y") for k, t in texts], DOCS)


ODD = [(1, None), (2, ""), (3, " "), (None, "some text here"), (None, None), (5, "same row"), (5, "same row"), (6, "x" * 30000 + " " + "word " * 3000), (7, "\U0001f600 é ñ")]


# Token store


def test_store_round_trip(spark, tmp_path):
    rng = random.Random(1)
    texts = [(i, " ".join(rng.choice(["the", "Étion", "don't", "a.b", "12,5", "日本"]) for _ in range(rng.randrange(60)))) for i in range(300)] + [(9, "again"), (None, "no key"), (400, None)]
    rng.shuffle(texts)
    path = str(tmp_path / "store")
    token_store.write_store(docs(spark, texts), path, tokenizer_path(), partitions=3, shard_ids=500)
    got = token_store.read_store(spark, path).collect()
    tok = word_ids(tokenizer_path()).tokenizer
    assert len(got) == len(texts)
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    by = {}
    for k, t in texts:
        by.setdefault(k, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    for r in got:
        ids = np.frombuffer(r.ids, "<u2").tolist()
        assert ids in by[r.doc_id] and len(ids) == r.n_tokens
    keys = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    sums = {(r.start): r.ids_crc32 for r in token_store.digests(token_store.read_store(spark, path)).collect()}
    assert all(sums[r.start] == zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for r in got)
    found = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in token_store.lookup(spark, path, [0, 17, 299, 100000]).collect()}
    assert set(found) == {0, 17, 299} and all(v in by[k] for k, v in found.items())


def test_perfect_hash():
    words = token_store.key_words(np.arange(5000), np.zeros(5000, np.int64))
    index = token_store.PerfectHash.build(words)
    assert sorted(index.slots(words)) == list(range(5000))


def test_store_empty(spark, tmp_path):
    token_store.write_store(docs(spark, []), str(tmp_path / "e"), tokenizer_path(), partitions=2)
    assert token_store.read_store(spark, str(tmp_path / "e")).count() == 0


@pytest.mark.parametrize("text", ["a\x1cb c", "<|endoftext|> x", "Σας ΟΔΟΣ", "it's I'LL 'sfoo", "日本語 テスト。 a b　c\u0085e", "İ ẞ ﬁ", "é x", "1234 12.5,7", ""])
def test_ids_are_the_tokenizers(text):
    w = word_ids(tokenizer_path())
    assert np.frombuffer(w.encode(text), w.dtype).tolist() == w.tokenizer.encode(text, add_special_tokens=False).ids


# Packing


def one_by_one(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [r for r in rooms if r >= n]
        if fit:
            rooms.remove(min(fit))
            rooms.append(min(fit) - n)
        else:
            rooms.append(capacity - n)
    return sorted(rooms)


def test_best_fit_is_that_of_single_pieces():
    for seed in range(40):
        rng = random.Random(seed)
        lengths = [rng.choice([1, 2, 3, rng.randint(1, 64), 64, 40]) for _ in range(rng.randrange(200))]
        counts = {n: lengths.count(n) for n in set(lengths)}
        used = {}
        for n, rank, placed, first, each, offset in packing.best_fit_runs(counts, 64).tolist():
            for j in range(placed):
                used.setdefault(first + j // each, []).append((offset + j % each * n, n))
        for pieces in used.values():
            at = 0
            for offset, n in sorted(pieces):
                assert offset == at
                at += n
            assert at <= 64
        assert sorted(64 - sum(n for _, n in p) for p in used.values()) == one_by_one(lengths, 64)


def test_pack(spark):
    texts = [*ODD, *[(100 + i, "the word " * (i * 7)) for i in range(60)]]
    got = packing.pack(docs(spark, texts), tokenizer_path(), capacity=128).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 128
    tok = word_ids(tokenizer_path()).tokenizer
    assert sum(r.length for r in got) == sum(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    r = next(r for r in got if r.doc_id == 159 and r.start == 128)
    ids = [*tok.encode("the word " * (59 * 7), add_special_tokens=False).ids, 2]
    assert r.ids_crc32 == zlib.crc32(np.asarray(ids[128 : 128 + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids)
    assert packing.pack(docs(spark, []), tokenizer_path()).count() == 0


# Decontamination


def contaminated_by_hand(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    words, hit, named = split(text), set(), set()
    for item, t in items:
        w = split(t)
        m = min(13, len(w))
        for i in range(len(w) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == w[i : i + m]:
                    hit |= set(range(j, j + m))
                    named.add(str(item))
    return len(words), len(hit), sorted(named)


@pytest.mark.parametrize("passes", [1 << 20, 60])
def test_decontamination(spark, passes):
    rng = random.Random(3)
    vocabulary = ["a", "bé", "C3", "d"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 13, 20])))) for i in range(6)] + [(7, None), (8, " !? ")]
    texts = [(100 + i, " ".join(rng.choice([*vocabulary, "zz", "y!"]) for _ in range(rng.randrange(60)))) for i in range(60)]
    texts += [(200 + i, f"xx yy {t} zz") for i, (_, t) in enumerate(items) if t] + ODD
    out = decontam.judged(decontam.find(docs(spark, texts), spark.createDataFrame(items, "item_id long, text string"), pass_bytes=passes)).collect()
    hand = {}
    for k, t in texts:
        hand.setdefault(k, []).append(contaminated_by_hand(t, items))
    assert len(out) == len(texts)
    for r in out:
        assert any((r.n_words, r.n_hit, r.n_items) == (n, h, len(x)) and r.items_sha256 == hashlib.sha256(",".join(x).encode()).hexdigest() for n, h, x in hand[r.doc_id]), r
    none = decontam.judged(decontam.find(docs(spark, ODD), spark.createDataFrame([], "item_id long, text string")))
    assert none.where("contaminated").count() == 0
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [list(t) for t in texts])
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", [list(t) for t in items])
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    rows = con.execute(f"SELECT {', '.join(columns)} FROM ({decontam.SQL})").fetchall()
    assert sorted(map(str, rows)) == sorted(str(tuple(r[c] for c in columns)) for r in out)


# Lines


def lines_by_hand(texts):
    seen, out = set(), {}
    for k, t in sorted({(k, t) for k, t in texts if t is not None}, key=lambda x: (x[0] is not None, x[0] or 0)):
        ls, gone = t.split("\n"), set()
        for i in range(len(ls) - 2):
            w = tuple(ls[i : i + 3])
            if not "".join(w).strip(" "):
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        out[k, t] = "\n".join(x for i, x in enumerate(ls) if i not in gone)
    return out


def test_lines(spark):
    rng = random.Random(5)
    texts = [(i, "\n".join(rng.choice("abcde ") for _ in range(rng.randrange(25)))) for i in range(80)]
    texts += [(81, "\n\n\n\n"), (82, "\n\n\n\n"), (83, "p\nq\nr\ns"), (84, "p\nq\nr\ns"), (85, "p\nq\nr\ns\nt"), *[x for x in ODD if x[0] != 5], (95, "one\ntwo\nthree"), (95, "one\ntwo\nthree")]
    hand = lines_by_hand(texts)
    got = line_dedup.dedup_lines(docs(spark, texts)).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.kept_text == (None if r.text is None else hand[r.doc_id, r.text]), r
    assert [r.kept_text for r in got if r.doc_id == 84] == [""] and [r.kept_text for r in got if r.doc_id == 85] == ["t"]
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


# Passages


def units_by_hand(text, least):
    """Every unit by trying all runs of sentences: (start, end, normalised)."""
    sentences, begin = [], 0
    for m in [*re.finditer(r"[.!?]+(?=\s)|[\u3002\uff01\uff1f]+|\n", text or ""), None]:
        end = m.end() if m else len(text or "")
        piece = (text or "")[begin:end]
        if piece.split():
            start = begin + len(piece) - len(piece.lstrip())
            stop = begin + len(piece.rstrip())
            sentences.append((start, stop, piece.lower().split(), (text or "")[:start].count("\n")))
        begin = end
    n, out = len(sentences), set()
    size = lambda i, j: sum(max(len(w), (e - s) // passage_dedup.WORD_CHARS) for s, e, w, _ in sentences[i : j + 1])
    for i in range(n):
        for j in range(i, n):
            lines = {s[3] for s in sentences[i : j + 1]}
            whole_line = len(lines) == 1 and (i == 0 or sentences[i - 1][3] not in lines) and (j == n - 1 or sentences[j + 1][3] not in lines)
            letters = any(c.isalnum() for c in text[sentences[i][0] : sentences[j][1]])
            enough = size(i, j) >= least
            if (
                enough and i <= j and (i == j or size(i, j - 1) < least)
                or enough and (i == j or size(i + 1, j) < least)
                or whole_line and enough and letters
                or i == 0 and j == n - 1 and not enough and letters
            ):
                unit = " ".join(" ".join(w) for _, _, w, _ in sentences[i : j + 1]).rstrip(".!?\u3002\uff01\uff1f")
                out.add((sentences[i][0], sentences[j][1], unit))
    return out


def repeats_by_hand(texts, least):
    first, rows = {}, []
    for k, t in sorted({(k, t) for k, t in texts if t}, key=lambda x: (x[0] is not None, x[0] or 0)):
        for start, end, unit in sorted(units_by_hand(t, least)):
            at = first.setdefault(unit, (k, t, start, end))
            if not (at[:2] == (k, t) and start < at[3]):
                rows.append((k, start, end, at[0], at[2]))
    return sorted(rows)


def test_passages_against_brute_force(spark):
    rng = random.Random(12)
    bits = ["One two three. ", "four five\n", "A b c d e f g! ", "x\n\n", "word ", "...\n", "日本語のとても長い文がここにある。", "Yes? ", "no space.end ", "A B\n"]
    texts = [(i, "".join(rng.choices(bits, k=rng.randrange(14)))) for i in range(150)] + [(200, "tiny text"), (201, "Tiny  TEXT."), (202, "!!!"), (203, "!!!"), (204, "same\nlines"), (205, "same\nlines")]
    for least in (4, 12):
        got = sorted((r.doc_id, r.start, r.end, r.first_doc_id, r.first_start) for r in passage_dedup.repeats(docs(spark, texts), least).collect())
        assert got == repeats_by_hand(texts, least)
    assert {g[0] for g in got} >= {201, 205} and not {202, 203} & {g[0] for g in got}


def test_passages(spark):
    common = "This long sentence stands in more than one of the very many documents."
    texts = [(11, f"Begin here. {common} End of it."), (12, f"Other words.\n{common.upper()} Done"), (13, f"{common} {common}"), *ODD, (14, "Short. Short. Short.")]
    got = sorted((r.doc_id, r.start, r.end, r.first_doc_id) for r in passage_dedup.repeats(docs(spark, texts)).where(F.col("end") - F.col("start") == len(common)).collect())
    assert [g[0] for g in got] == [12, 13, 13] and all(g[3] == 11 for g in got)
    kept = {r.doc_id: (r.kept_text, r.removed) for r in passage_dedup.remove(docs(spark, texts)).collect()}
    assert kept[11][0] == texts[0][1] and kept[12][0] == "Other words.\n Done" and kept[13][0].strip() == ""
    assert texts[1][1][kept[12][1][0]["start"] : kept[12][1][0]["end"]] == common.upper()
    assert passage_dedup.repeats(docs(spark, [])).count() == 0
    twice = [(1, common), (1, common), (2, common)]
    assert [(r.doc_id, r.first_doc_id, r.first_start) for r in passage_dedup.repeats(docs(spark, twice)).collect()] == [(2, 1, 0)]


def test_passages_of_short_units(spark):
    passage = " ".join(f"Word{i} is {'here' if i % 3 else 'now'}." for i in range(16)) + " Yes."
    shouts = " ".join(f"SHOUT{i}!!" for i in range(30))
    lines = "\n".join(f"line {i}" for i in range(20))
    texts = [(1, f"A start. {passage} The end."), (2, f"Something else. {passage} And more."), (3, shouts), (4, shouts), (5, f"own words\n{lines}"), (6, f"{lines}\nother words"), (7, "Ha! " * 30), (8, "a b\nc"), (9, "A b\nc.")]
    kept = {r.doc_id: " ".join(r.kept_text.split()) for r in passage_dedup.remove(docs(spark, texts)).collect()}
    assert kept[1] == texts[0][1] and kept[3] == shouts and kept[5].split() == texts[4][1].split() and kept[8] == "a b c"
    assert kept[2] == "Something else. And more." and kept[4] == "" and kept[6] == "other words" and kept[7] == ("Ha! " * 12).strip() and kept[9] == ""


# SimHash


def test_simhash_components(spark):
    rng = random.Random(2)
    base = [" ".join(f"w{rng.randrange(50)}" for _ in range(80)) for _ in range(40)]
    texts = []
    for i, b in enumerate(base):
        for j in range(4):
            w = b.split()
            for _ in range(j):
                w[rng.randrange(80)] = "q"
            texts.append((i * 10 + j, " ".join(w)))
    texts += [(1000, ""), (1001, None), (1002, "A b"), (1003, "a B")]
    rows = simhash.near_duplicates(docs(spark, texts)).collect()
    fps = {r.doc_id: int(r.fingerprint, 16) for r in rows}
    import xxhash

    for k, t in texts[:20]:
        w = re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower())
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(len(w) - 2)]
        assert fps[k] == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {k: k for k in fps}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2 and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {r.doc_id: r.component_id for r in rows} == {k: find(k) for k in fps}
    assert fps[1000] == fps[1001] == 0 and fps[1002] == fps[1003]


@pytest.mark.parametrize("tau", [2, 5, 7])
def test_pigeonhole_finds_every_link(spark, tau):
    """Random fingerprints with planted neighbours, and a crowd around one value that has to be split into blocks."""
    rng = np.random.default_rng(tau)
    fp = rng.integers(0, 1 << 63, 300, dtype=np.int64)
    planted = fp[:100].copy()
    for i in range(100):
        for b in rng.choice(64, rng.integers(1, tau + 2), replace=False):
            planted[i] = np.int64(np.uint64(planted[i]) ^ (np.uint64(1) << np.uint64(b)))
    crowd = np.asarray([np.int64(np.uint64(fp[0]) ^ np.uint64((1 << a) | (1 << b))) for a in range(60) for b in range(a)])[: 1500 if tau == 2 else 200]
    every = np.unique(np.concatenate([fp, planted, crowd]))
    nodes = spark.createDataFrame([(int(x), int(x)) for x in every], "node long, fp long")
    n, both = simhash.bit_counts(nodes)
    plan = simhash.thresholds(n, both, tau)
    assert n == every.size and sum(t + 1 for _, t in plan) == tau + 1
    comp = {r.node: r.component for r in graph.connected_components(simhash.links(nodes, tau)).collect()}
    u = every.view(np.uint64)
    a, b = np.nonzero(np.triu(np.bitwise_count(u[:, None] ^ u[None, :]) <= tau, 1))
    head, other = graph.spanning(every[a], every[b])
    want = dict(zip(other.tolist(), head.tolist())) | {h: h for h in head.tolist()}
    assert {k: v for k, v in comp.items()} == want


def test_keep_one(spark):
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(200))
    near, far = text.replace(text.split()[100], "changed"), " ".join(f"v{rng.randrange(500)}" for _ in range(200))
    kept = simhash.keep_one(docs(spark, [(1, text), (2, near), (3, far), (4, text), (None, text)])).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3] and simhash.keep_one(docs(spark, [])).count() == 0


def test_keep_one_in_blocks(spark, monkeypatch):
    """A large group of copies with others on its edge, dealt into blocks: what stays is what brute force leaves."""
    monkeypatch.setattr(simhash, "BLOCK", 8)
    rng = random.Random(31)
    sets = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    base = [f"w{rng.randrange(900)}" for _ in range(150)]
    texts = [(0, base)]
    for i in range(1, 70):  # few edits (joined to the first), or about as many as the rule allows
        w = list(base)
        for _ in range(rng.choice([1, 2, 3, 4])):
            w[rng.randrange(150)] = f"q{rng.randrange(9)}"
        texts.append((i, w))
    parent = list(range(70))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    shingles = [sets(w) for _, w in texts]
    for a, b in itertools.combinations(range(70), 2):
        if len(shingles[a] & shingles[b]) >= 0.8 * len(shingles[a] | shingles[b]) and find(a) != find(b):
            parent[max(find(a), find(b))] = min(find(a), find(b))
    kept = {r.doc_id for r in simhash.keep_one(docs(spark, [(k, " ".join(w)) for k, w in texts])).collect()}
    assert kept == {find(k) for k in range(70)} and 1 <= len(kept) < 30


def test_keep_one_finds_every_near_copy(spark):
    """Truncated and edited copies at a similarity of 0.8 and more lose one side; those under 0.8 stay."""
    rng = random.Random(11)

    def jaccard(a, b):
        a, b = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
        return len(a & b) / len(a | b)

    texts, expected = [], set()
    for i in range(120):
        w = [f"w{i}x{rng.randrange(400)}" for _ in range(rng.randrange(60, 400))]
        copy = w[: round(len(w) * rng.uniform(0.76, 0.9))] if i % 2 else [x if rng.random() > 0.03 else f"q{rng.random()}" for x in w]
        texts += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(copy))]
        expected |= {2 * i} if jaccard(w, copy) >= 0.8 else {2 * i, 2 * i + 1}
    assert 140 < len(expected) < 220
    assert {r.doc_id for r in simhash.keep_one(docs(spark, texts)).collect()} == expected


# Languages


def test_languages(spark):
    words = {"en": "the of and to that with from have this which", "de": "der die und nicht mit sich auf für eine schön", "el": "και το να είναι για με δεν που"}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choices(words[lang].split(), k=20)), lang) for i in range(120) for lang in [rng.choice(list(words))]]
    train = spark.createDataFrame(rows[:80] + [(900, None, "en"), (901, "text", None)], "doc_id long, text string, lang string")
    model = langid.fit(train)
    assert model.langs == ["de", "el", "en"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs(spark, [(i, t) for i, t, _ in rows[80:]]), model).collect()}
    assert all(got[i][0] == lang and 0 <= got[i][1] <= 1 for i, _, lang in rows[80:])
    odd = langid.predict(docs(spark, ODD + [(50, "12 34 !")]), model).collect()
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in odd)
    nothing = langid.predict(docs(spark, ODD), langid.fit(train.limit(0))).collect()
    assert {r.lang_pred for r in nothing} == {"und"}


def test_language_filters_hold_the_ngrams(spark):
    """Every n-gram of a language is found, others about as often as the filters' false positives say, and counts are corrected."""
    rng = random.Random(14)
    make = lambda letters: ["".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(400)]
    own = {"aa": make("abcdefghijk"), "bb": make("lmnopqrstuv")}
    train = spark.createDataFrame([(" ".join(rng.choices(w, k=300)), lang) for lang, w in own.items() for _ in range(5)], "text string, lang string")
    model = langid.fit(train).filter()
    assert model.false_positive.max() < 0.02
    for i, (lang, w) in enumerate(sorted(own.items())):
        text = " ".join(r.text for r in train.where(F.col("lang") == lang).collect())
        sums, n = model.tally([text])
        share, grams = langid.shares(sums, n), langid.ngrams([f" {text} "])[0]
        assert n[0] == grams.size and share[0, i] > 0.999 and share[0, 1 - i] < 0.02
    full = langid.Model(["aa"], [np.ones(8, np.uint8)], np.ones(1))
    assert np.isfinite(full.tally(["text"])[0]).all()


def test_language_filters_in_parts(spark):
    """Below a bound of bytes the n-grams are divided: every filter keeps to the bound, and texts get the scores of exact n-gram sets."""
    rng = random.Random(15)
    make = lambda letters: ["".join(rng.choices(letters, k=rng.randrange(3, 9))) for _ in range(300)]
    own = {"aa": make("abcdefghijk"), "bb": make("ghijklmnopq")}
    rows = [(i, " ".join(rng.choices(own[lang], k=60)), lang, "kept") for i in range(60) for lang in ["ab"[i % 2] * 2]]
    table = spark.createDataFrame([*rows, (900, None, "aa", "kept"), (901, "", "aa", "kept"), (902, "1 2", None, "kept")], "doc_id long, text string, lang string, _sums string")
    train = table.where("doc_id % 3 <> 1")
    parted = langid.fit(train, share=0.0, filter_bytes=1 << 15)
    assert parted.parts > 2 and parted.slots * 8 <= 1 << 15
    held = {lang: set() for lang in own}
    for i, text, lang, _ in rows:
        if i % 3 != 1:
            held[lang] |= set(langid.ngrams([f" {text} "])[0].tolist())
    got = {r.doc_id: r for r in langid.predict(table, parted).collect()}
    assert {r["_sums"] for r in got.values()} == {"kept"} and len(got) == 63
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    for i, text, _, _ in rows:
        grams = langid.ngrams([f" {text} "])[0].tolist()
        exact = {lang: np.mean([g in h for g in grams]) for lang, h in held.items()}
        assert got[i].lang_pred == max(exact, key=exact.get) and got[i].score == pytest.approx(max(exact.values()), abs=0.01)


def test_ties_between_languages(spark):
    same = spark.createDataFrame([("one text", "b"), ("one text", "a")], "text string, lang string")
    assert [r.lang_pred for r in langid.predict(docs(spark, [(1, "one text")]), langid.fit(same)).collect()] == ["a"]


def test_language_segments_do_not_matter(monkeypatch):
    texts = ["ein langer text über viele dinge", "kurz", None, "a"]
    whole = [np.sort(np.concatenate([langid.ngrams(p)[0] for _, p in langid.segments([t])] or [np.zeros(0, np.uint64)])) for t in texts]
    monkeypatch.setattr(langid, "SEGMENT", 5)
    assert all((w == np.sort(np.concatenate([langid.ngrams(p)[0] for _, p in langid.segments([t])] or [np.zeros(0, np.uint64)]))).all() for w, t in zip(whole, texts))


# Toxicity


def test_kernel_by_hand():
    def slow(a, b):
        from collections import Counter

        def vec(w):
            s, out = f"^{w}$", Counter()
            for c in itertools.combinations(range(len(s)), 3):
                out[s[c[0]], s[c[1]], s[c[2]]] += toxicity.DECAY ** (c[2] - c[0] + 1)
            return out

        x, y = vec(a), vec(b)
        dot = lambda p, q: sum(v * q[k] for k, v in p.items())
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    words = ["idiot", "idxiot", "loser", "banana", "abc", "aaaa", "mississippi"]
    k = toxicity.kernel(words, words[:3])
    assert np.allclose(k, [[slow(a, b) for b in words[:3]] for a in words], atol=1e-5)
    assert k[1, 0] > k[2, 0]


def test_machine_is_that_of_the_kernel():
    """The weights of subsequences give what the kernel against the landmarks gives, whitened and separated."""
    rng = random.Random(17)
    marks = ["idiot", "idiots", "stupid", "loser", "house", "water", "green", "stone", "paper", "light"]
    words = [*marks, "idxiot", "stuppid", "river", "table", "seven", "cloud"]
    y = np.asarray([1.0 if w[:3] in ("idi", "idx", "stu", "los") else -1.0 for w in words])
    cost = np.asarray([rng.randint(1, 9) for _ in words], float)
    values, vectors = np.linalg.eigh(toxicity.kernel(marks, marks))
    whiten = (vectors / np.sqrt(np.maximum(values, 1e-3))) @ vectors.T
    share = np.where(y > 0, cost / cost[y > 0].sum(), cost / cost[y < 0].sum()) * len(words) / 2
    w, bias = toxicity.fit_svm(toxicity.kernel(words, marks) @ whiten, y, share)
    asked = [*words, "idiotic", "mississippi", "looser", "ab", "xyzzy"]
    direct = toxicity.kernel(asked, marks) @ whiten @ w + bias
    got = toxicity._machine(marks, words, y, cost).word_scores(asked)
    assert np.allclose(got[[len(a) >= 3 for a in asked]], direct[[len(a) >= 3 for a in asked]], atol=1e-3)
    assert got[asked.index("idxiot")] > 0 > got[asked.index("river")]


def test_toxicity_of_held_out_rows(spark):
    from sluice.llm import queries

    sf = "/root/testdata/sf0.01"
    got = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, fine = [r for r in got if r.toxic == 1], [r for r in got if r.toxic == 0]
    assert np.mean([r.predicted for r in toxic]) >= 0.5 and np.mean([r.predicted for r in fine]) <= 0.1
    ranks = [(a.score > b.score) + (a.score == b.score) / 2 for a in toxic for b in fine]
    assert np.mean(ranks) > 0.8 and all((r.score >= 0.3) == (r.predicted == 1) for r in got)


def test_toxicity(spark):
    rng = random.Random(6)
    plain = "the of and to house tree water stone light paper river cloud seven green table".split()
    insults = ["idiot", "moron", "clown", "loser"]
    rows, labels = [], []
    for i in range(600):
        w = rng.choices(plain, k=15)
        if i % 3 == 0:
            w[rng.randrange(15)] = rng.choice(insults)
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 3 == 0)))
    lab = spark.createDataFrame(labels[:400] + [(7, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs(spark, rows), lab)
    got = {r.doc_id: (r.score, r.predicted) for r in toxicity.score(docs(spark, rows[400:] + [(1001, "you are an i d i o t"), (1002, "such an idxiot here"), (1003, "green paper")]), model).collect()}
    assert np.mean([got[i][1] == y for i, y in labels[400:]]) > 0.97
    assert got[1001][1] == 1 and got[1002][1] == 1 and got[1003][1] == 0
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs(spark, ODD), model).collect())
    assert toxicity.score(docs(spark, ODD), toxicity.fit(docs(spark, rows), lab.where("toxic = 0"))).where("score > 0").count() == 0


# Neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 16))
    x[100:200] = x[0] + 0.01 * rng.standard_normal((100, 16))
    x[300] = x[301]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [float("inf")] * 16), (None, [1.0] * 16), (1004, [None] + [1.0] * 15), rows[5]]
    df = ann.usable(spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>"))
    assert df.count() == 600
    got = {}
    for r in ann.search(df, df.where("vec_id % 20 = 0"), 10).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    recall = []
    for q in range(0, 600, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(600), -s))[:10]
        mine = [got[q][k] for k in range(1, 11)]
        assert all(abs(score - s[i]) < 1e-9 for i, score in mine) and mine == sorted(mine, key=lambda m: (-m[1], m[0]))
        recall.append(len({i for i, _ in mine} & set(best.tolist())) / 10)
    assert np.mean(recall) >= 0.9
    few = df.where("vec_id < 3")
    assert ann.search(few, few, 10).groupBy("query_id").count().where("count <> 2").count() == 0
    assert ann.search(df.limit(0), df.limit(0), 10).count() == 0


def test_neighbours_of_the_given_vectors(spark):
    """Recall against brute force on the table that the query reads."""
    from sluice.llm import queries

    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()]
    ids, x = np.asarray([r.vec_id for r in rows]), np.asarray([r.embedding for r in rows], float)
    got = {}
    for r in queries.op2_nearest_neighbours(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        s[i] = -np.inf
        recall.append(len(got[ids[i]] & set(ids[np.lexsort((ids, -s))[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_vectors_of_two_lengths_and_extra_columns(spark):
    rows = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(40)] + [(100 + i, [1.0, float(i)]) for i in range(5)] + [(3, [9.0, 9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("v", "size", "shard", "asks", "score", "rank", "query_id")})
    every = ann.usable(df)
    got = ann.search(every, every.where("vec_id in (0, 100)"), 4, rerank=1.0).collect()
    assert {r.vec_id for r in got if r.query_id == 100} == {101, 102, 103, 104}
    best = [(r.vec_id, r.score) for r in sorted(got, key=lambda r: r.rank) if r.query_id == 0]
    scores = {}
    for i, v in rows[1:]:
        if len(v) == 3:
            scores[i] = max(scores.get(i, -1.0), sum(a * b for a, b in zip(v, rows[0][1])))
    assert best == sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:4]


# Personal data

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def spans_by_hand(text):
    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0

    def holds(kind, m):
        d = re.sub("[^0-9]", "", m)
        return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m.split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in KINDS for m in re.finditer(p, text or "", re.ASCII) if holds(k, m.group())]


def test_personal_data(spark):
    rng = random.Random(9)
    bits = ["a@b.c", "d_e@f.g", "@", ".", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (555) 123-4567", "+", "-", " ", "é", "\U0001f600", "12", "x", "(", "0", "00010.2.3.4", "_"]
    texts = [(i, "".join(rng.choices(bits, k=rng.randrange(12)))) for i in range(400)]
    texts += [(900, "a" * 50000 + "@b"), (901, "1" * 50000), (902, "1 " * 30000), (903, "1.2.3." * 20000), (904, "a@b" + ".c" * 20000), *ODD]
    got = pii.summary(docs(spark, texts)).collect()
    by = {}
    for k, t in texts:
        by.setdefault(k, []).append(spans_by_hand(t))
    assert len(got) == len(texts)
    for r in got:
        assert any(r.base_sha256 == hashlib.sha256(",".join(s).encode()).hexdigest() for s in by[r.doc_id]), (r.doc_id, by[r.doc_id], r.spans)
        assert r.spans.split(",")[0] == "" or r.n_term or r.spans.split(",") in by[r.doc_id]
    assert pii.summary(docs(spark, [])).count() == 0


def replaced(text, spans):
    """The sanitised text and the number of brackets, span by span."""
    kinds = (*pii.KINDS, "term")
    out, at, n = "", 0, 0
    for start, _, end, kind in sorted((int(a), kinds.index(k), int(b), k) for k, a, b in (s.split(":") for s in spans.split(",") if s)):
        if start >= at:
            out, n = f"{out}{text[at:start]}[{kind.upper()}]", n + 1
        at = max(at, end)
    return out + text[at:], n


def cleaned(texts, got):
    for (i, text), r in zip(sorted(texts), sorted(got, key=lambda r: r.doc_id)):
        clean, n = replaced(text or "", r.spans)
        assert i == r.doc_id and (r.n_replaced, r.clean_sha256) == (n, hashlib.sha256(clean.encode()).hexdigest()), i


def test_sanitised_texts(spark):
    mail, card = "ann.lee@mail.example.org", "4111 1111 1111 1111"
    texts = [(1, f"write to {mail}, or {card}"), (2, None), (3, ""), (4, "nothing here"), (5, f"é {mail}{mail} +{card} 10.0.0.1 ok"), (6, f"{mail} " * 300)]
    got = pii.summary(docs(spark, texts)).collect()
    cleaned(texts, got)
    assert {r.doc_id: r.n_replaced for r in got}[6] == 300
    named = docs(spark, texts).withColumn("clean_text", F.lit("kept")).withColumn("made", F.lit("kept"))
    assert {r.made for r in pii.sanitise(named).collect()} == {"kept"}


def test_disclosing_terms(spark):
    rng = random.Random(1)
    plain = "house tree water stone light paper river cloud seven green".split()
    texts = [(i, f"{rng.choice(plain)} {rng.choice(plain)} contact Zephyrine at zeph@mail.org {rng.choice(plain)} nr {i}") for i in range(6)]
    texts += [(100 + i, " ".join(rng.choices(plain, k=12)) + f" contact us at u{i}@mail.org") for i in range(200)]
    got = {r.doc_id: r for r in pii.summary(docs(spark, texts)).collect()}
    for i in range(6):
        t = texts[i][1]
        terms = [t[int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"]
        assert terms == ["Zephyrine"], terms
    assert sum(got[100 + i].n_term for i in range(200)) == 0
    cleaned(texts, got.values())
    clean = {r.doc_id: r.clean_text for r in pii.sanitise(docs(spark, texts[:8])).collect()}
    assert "zeph@mail.org" not in clean[0] and "[EMAIL]" in clean[0]


def test_disclosing_terms_far_from_the_entity(spark):
    """A term in another sentence, and in a document without the entity, is found."""
    rng = random.Random(3)
    plain = "house tree water stone light paper river cloud seven green".split()
    fill = lambda n: " ".join(rng.choices(plain, k=n))
    texts = [(i, f"Quillimore {fill(40)}. {fill(20)} q@mail.org {fill(20)}") for i in range(5)]
    texts += [(50, f"{fill(9)} quillimore {fill(9)}")] + [(100 + i, fill(40)) for i in range(300)]
    got = {r.doc_id: r for r in pii.summary(docs(spark, texts)).collect()}
    assert [got[i].n_term for i in (*range(5), 50)] == [1] * 6 and sum(got[100 + i].n_term for i in range(300)) == 0
    assert got[0].spans.endswith("term:0:10")


def test_edited_copies_are_no_evidence(spark):
    """Copies with a word put in somewhere count once; unrelated texts that share a passage count each."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    fill = lambda n: " ".join(word() for _ in range(n))
    copied, passage = [word() for _ in range(60)], fill(12)
    texts = [(i, " ".join([*copied[:at], word(), *copied[at:]]) + " c@mail.org") for i, at in enumerate((0, 0, 20, 40, 59))]
    texts += [(10 + i, f"{fill(20 + i)} {passage} Quillimore {fill(30)} q@mail.org") for i in range(5)]
    texts += [(100 + i, f"{passage if i % 5 == 0 else fill(12)} {fill(20)}") for i in range(300)]
    near = spark.createDataFrame([(i, t) for i, t in texts if i < 50], "text_key long, text string")
    found = {r.text_key: r.copy_class for r in pii.classes(near).collect()}
    assert len({found[i] for i in range(5)}) == 1 and len({found[10 + i] for i in range(5)}) == 5
    got = {r.doc_id: r for r in pii.summary(docs(spark, texts)).collect()}
    assert [got[i].n_term for i in range(5)] == [0] * 5 and [got[10 + i].n_term for i in range(5)] == [1] * 5


def test_entities_of_one_text_are_judged(spark):
    """By chance alone: one meeting is enough where few pairs are judged in many documents, and not where many are."""
    texts = [(0, "xandrine wrote x0@mail.org y0@mail.org"), *[(100 + i, f"river{i % 40} stone{i % 7} wrote") for i in range(1500)]]
    got = {r.doc_id: r for r in pii.summary(docs(spark, texts)).collect()}
    assert got[0].spans.endswith("term:0:8") and got[0].n_term == 1 and sum(got[100 + i].n_term for i in range(1500)) == 0
    listed = [(0, "xandrine wrote " + " ".join(f"x{i}@mail.org" for i in range(40))), *texts[1:]]
    frame = docs(spark, listed)
    spans = pii.base_spans(pii.holding(frame))
    assert sorted((r.word, r.alike, r.times) for r in pii.met(pii.holding(frame), spans).collect()) == [("wrote", 40, 1), ("xandrine", 40, 1)]
    assert pii.disclosing(frame, pii.holding(frame), spans).count() == 0


def test_pairs_do_not_grow_with_the_square_of_copies(spark, monkeypatch):
    """Copies that hold many entities each list no pairs of entity and word; unrelated texts are judged as before."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    fill = lambda n: " ".join(word() for _ in range(n))
    copied = fill(150)
    texts = [(i, f"{copied} {word()} " + " ".join(f"u{j}@mail.org" for j in range(60) if j != i)) for i in range(60)]
    texts += [(100 + i, f"{fill(20 + i)} Quillimore {fill(30)} q@mail.org") for i in range(6)]
    texts += [(200 + i, fill(8)) for i in range(300)]
    rows, keep = {}, pii.written

    def counting(df, label):
        out = keep(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(pii, "written", counting)
    got = {r.doc_id: r for r in pii.summary(docs(spark, texts)).collect()}
    assert [got[100 + i].n_term for i in range(6)] == [1] * 6 and [got[i].n_term for i in range(60)] == [0] * 60
    assert rows["pii-held"] == 60 * 59 + 6 and rows["pii-pairs"] < 100


# Extra columns


CLASHING = ["_id", "_key", "__id", "TEXT_KEY", "lines", "spans", "score", "predicted", "lang_pred", "removed", "ranges", "n_hit", "component", "h", "word", "kinds", "blocks", "start", "length", "part"]


def test_columns_with_clashing_names(spark):
    """Every operator gives what it gives without the extra columns, and keeps those that it does not define."""
    rng = random.Random(5)
    words = "house tree water stone light paper river cloud seven green".split()
    texts = [(i, "\n".join(" ".join(rng.choices(words, k=6)) for _ in range(rng.randrange(5)))) for i in range(30)]
    texts += [(40 + i, texts[5][1]) for i in range(3)] + [(50, "mail a@b.org now"), (None, "text here"), (51, None), (52, "")]
    plain = spark.createDataFrame(texts, "doc_id long, text string")
    wide = plain.withColumns({c: F.lit("kept") for c in CLASHING})
    bench = spark.createDataFrame([("i", " ".join(texts[3][1].split()[:14]))], "item_id string, text string")
    bench_wide = bench.withColumns({c: F.lit("kept") for c in ("_id", "ids", "n_words")})
    lab = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    lang, toxic = langid.fit(plain.withColumn("lang", F.lit("en"))), toxicity.fit(wide, lab.withColumns({"text": F.lit("x"), "h": F.lit(1)}))
    cases = {
        "lines": lambda d: line_dedup.dedup_lines(d),
        "passages": lambda d: passage_dedup.remove(d, 4),
        "near": lambda d: simhash.keep_one(d),
        "language": lambda d: langid.predict(d, lang),
        "toxicity": lambda d: toxicity.score(d, toxic),
        "benchmark": lambda d: decontam.judged(decontam.find(d, bench if d is plain else bench_wide)),
        "spans": lambda d: pii.with_spans(d),
        "clean": lambda d: pii.sanitise(d),
    }
    for name, run in cases.items():
        narrow, broad = run(plain), run(wide)
        assert sorted(map(str, narrow.collect())) == sorted(map(str, broad.select(narrow.columns).collect())), name
        kept = [c for c in CLASHING if c not in narrow.columns]
        assert broad.select(*[F.min(f"`{c}`") for c in kept]).head() == tuple(["kept"] * len(kept)), name
    for run in (simhash.near_duplicates, pii.summary, lambda d: passage_dedup.repeats(d, 4), lambda d: packing.pack(d, tokenizer_path())):
        assert sorted(map(str, run(plain).collect())) == sorted(map(str, run(wide).collect()))


# Pipeline


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs_ = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs_.collect()}
        docs_ = stage(spark, docs_, sf)
        assert docs_.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        after = {r.doc_id: r.text for r in docs_.collect()}
        assert set(after) <= set(before)
        if name == "line dedup":
            hand = lines_by_hand(before.items())
            assert after == {k: v for (k, t), v in hand.items() if v == t or v.strip(" ")}
        if name == "benchmark decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
            hits = {k: contaminated_by_hand(t, items)[:2] for k, t in before.items() if len(t) < 3000}
            assert all((k in after) == (not (h and 20 * h >= n)) for k, (n, h) in hits.items())
        docs_ = spark.createDataFrame(docs_.collect(), docs_.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs_, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs_.collect()}


def test_pipeline_keeps_every_column(spark):
    """Columns named like what the stages compute hold their values after each of them; n_chars need not be there."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    names = ["score", "predicted", "n_lines", "n_removed", "ranges", "kept_text", "n_words", "n_hit", "n_items", "contaminated", "hit_items", "component", "_carried_0", "text_key"]
    docs_ = spark.read.parquet(f"{sf}/documents.parquet").limit(60).select("doc_id", "text")
    wide = docs_.select(*[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in names[:7]], "text", "doc_id", *[F.lit(c).alias(c) for c in names[7:]])
    state = wide
    for name, stage in corpus_pipeline.STAGES[:-1]:
        state = stage(spark, state, sf)
        assert state.columns == wide.columns, name
        for r in (rows := state.collect()):
            assert [r[c] for c in names] == [f"{c} of {r.doc_id}" for c in names[:7]] + names[7:], name
        state = spark.createDataFrame(rows, state.schema)
    assert rows and corpus_pipeline.STAGES[-1][1](spark, state, sf).count() >= len(rows)


def test_pipeline_on_odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, ties, extra columns and no rows at all go through all stages."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    rng = random.Random(21)
    body = lambda: " ".join(f"w{rng.randrange(900)}" for _ in range(80))
    copy, item = body(), spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 100").head().text
    texts = [*ODD, (20, copy), (21, copy), (21, copy), (22, copy + " tail"), (30, f"{body()}\nl1\nl2\nl3"), (31, f"l1\nl2\nl3\n{body()}"), (32, "l1\nl2\nl3"), (40, item), (50, body())]
    made = spark.createDataFrame([(k, t, "en", "web", len(t or "")) for k, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    for wide in (False, True):
        state = made.withColumns({c: F.lit("kept") for c in ("_id", "lines", "text_key", "score", "spans")}) if wide else made
        columns = state.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            state = stage(spark, state, sf)
            state = spark.createDataFrame(state.select(columns).collect(), state.select(columns).schema)
        left = sorted((r.doc_id is not None, r.doc_id or 0) for r in state.collect())
        ids = [k for known, k in left if known]
        assert {20, 30, 31, 50} <= set(ids) and not {21, 22, 32, 40} & set(ids) and ids.count(5) == 2 and left.count((False, 0)) == 2
        kept = {r.doc_id: r.text for r in state.collect()}
        assert kept[31] == texts[[k for k, _ in texts].index(31)][1].split("\n", 3)[3] and kept[6] == ODD[7][1]
        packed = corpus_pipeline.STAGES[-1][1](spark, state, sf).collect()
        assert {r.doc_id for r in packed} == set(kept)
    state = made.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        state = stage(spark, state, sf)
        assert state.count() == 0
