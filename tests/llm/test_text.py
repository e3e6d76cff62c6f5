"""SimHash, substring dedup, decontamination, pseudonyms, tokens, packing, classifier, HTML: against brute force, round trips, held-out labels."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.llm import classifier, common, decontamination, html, packing, pii, simhash, substrings, token_counts, tokens
from tests.llm import brute
from tests.llm.cases import DATA, EDGES, PROSE, documents, edge_documents

KEY = b"test"


# SimHash


def test_fingerprints_equal_brute_force():
    for _, text in EDGES:
        assert simhash.fingerprint(text) == brute.simhash(text)


def test_near_duplicates_equal_brute_force(spark):
    docs = edge_documents(spark)
    got = simhash.near_duplicates(docs).collect()
    texts = dict(e for e in EDGES if e[0] is not None)
    label = brute.components(sorted((i, brute.simhash(t)) for i, t in texts.items()))
    assert len(got) == len(EDGES) and len({label[1], label[2]}) == 1
    for r in got:
        if r.doc_id is not None:
            assert int(r.fingerprint, 16) == brute.simhash(texts[r.doc_id]) and r.component_id == label[r.doc_id]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == sorted(set(label.values())) and kept.where("doc_id IS NULL").count() == 2


@pytest.mark.parametrize("cell_rows", [1, 4, 1024])
def test_links_in_tiles_and_split_cells(spark, cell_rows):
    """Balls of near fingerprints, chains and strangers; cells far above cell_rows."""
    r = random.Random(3)
    fps = {r.getrandbits(64) for _ in range(60)}
    for _ in range(4):
        x = r.getrandbits(64)
        for _ in range(25):
            fps.add(x ^ (1 << r.randrange(64)) ^ (1 << r.randrange(22)))
            x ^= 3 << r.randrange(63) if r.random() < 0.3 else 0
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    labels = {r.fp & (2**64 - 1): r.label & (2**64 - 1) for r in simhash.fingerprint_components(nodes, cell_rows=cell_rows).collect()}
    want = brute.components([(f, f) for f in fps])
    group = lambda of: {frozenset(f for f in fps if of(f) == of(x)) for x in fps}
    assert group(lambda f: labels.get(f, f)) == group(want.__getitem__)


def test_dense_cells_are_split_on_further_blocks(spark):
    """20,000 fingerprints that share a block of bits: few rows each, no pair within the radius is lost."""
    r = np.random.default_rng(8)
    fps = np.unique((r.integers(0, 2**62, 20_000, dtype=np.int64) >> 21) << 21)
    near = fps[:300] ^ (np.int64(1) << r.integers(21, 62, 300)) ^ (np.int64(1) << r.integers(21, 62, 300))
    nodes = spark.createDataFrame([(int(x),) for x in np.unique(np.concatenate([fps, near]))], "fp long")
    rows = simhash.cells(nodes, 2, 512)
    n, most = rows.count(), rows.groupBy("cell").count().agg(F.max("count")).first()[0]
    assert n <= (2 + 6) * nodes.count() and most <= 512
    by_fp = {}
    for x in rows.where(F.col("fp").isin([int(v) for v in [*fps[:300], *near]])).collect():
        by_fp.setdefault(x.fp, set()).add(x.cell)
    assert all(by_fp[int(a)] & by_fp[int(b)] for a, b in zip(fps[:300], near))


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(200, 200), (7, 3)]
    got = {r.node: r.label for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and len({got[i] for i in range(100, 140)}) == 1 and got[5] != got[105] and 200 not in got
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Substring dedup


WAYS = [{}, {"shard_rows": 1}, {"shard_rows": 1, "reference": 0}, {"shard_rows": 2, "shard_words": 50}]


@pytest.mark.parametrize("ways", WAYS)
def test_repeats_equal_brute_force(spark, ways):
    """Shards by content, a broadcast reference, its windows in a join, a reference of several shards."""
    docs = edge_documents(spark)
    got = substrings.remove_repeats(docs, digest=True, **ways).collect()
    want = brute.removed([t for _, t in EDGES])
    assert sorted(map(str, map(tuple, got))) == sorted(str((i, *w)) for (i, _), w in zip(EDGES, want))
    assert substrings.remove_repeats(docs.limit(0)).count() == 0


@pytest.mark.parametrize("ways", WAYS)
def test_repeats_in_periodic_and_overlapping_texts(spark, ways):
    r = random.Random(5)
    base = [f"w{r.randrange(40)}" for _ in range(300)]
    texts = []
    for _ in range(40):
        a = r.randrange(250)
        texts.append(" ".join(["s%d" % r.randrange(9)] * r.randrange(60) + base[a : a + r.randrange(1, 90)] + [f"v{r.randrange(1000)}"] * r.randrange(3)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substrings.remove_repeats(docs, digest=True, **ways).collect()}
    assert [got[i] for i in range(40)] == brute.removed(texts)


def test_passages_hold_their_windows_and_no_others():
    r = random.Random(4)
    for _ in range(200):
        n, text = r.randint(1, 4), [r.choice([b"a", b"b", b"c"]) for _ in range(r.randint(4, 40))]
        windows = sorted({tuple(text[i : i + n]) for i in range(len(text) - n + 1) if r.random() < 0.8})
        merged = substrings.passages([list(w) for w in windows])
        assert sorted(tuple(p[i : i + n]) for p in merged for i in range(len(p) - n + 1)) == windows
        other = [r.choice([b"a", b"b", b"c", b"d"]) for _ in range(60)]
        found = set()
        for shard in substrings.reference_shards([list(w) for w in windows], 10):
            found.update(shard.matching(other, n))
        assert found == {i for i in range(len(other) - n + 1) if tuple(other[i : i + n]) in set(windows)}


def test_automaton_counts():
    r = random.Random(2)
    for _ in range(100):
        sequences = [[r.choice("ab") for _ in range(r.randrange(1, 12))] for _ in range(3)]
        a = substrings.Automaton()
        for s in sequences:
            a.add(s, 1)
        a.finish()
        for window in (1, 2, 4):
            n = Counter(tuple(s[i : i + window]) for s in sequences for i in range(len(s) - window + 1))
            for s in sequences:
                assert a.repeated(s, window) == [i for i in range(len(s) - window + 1) if n[tuple(s[i : i + window])] > 1]


# Decontamination


def test_leaks_are_found_and_clean_documents_left_alone(spark):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 6)))
    items = [(i, " ".join(word() for _ in range(n)) + ". " + " ".join(word() for _ in range(6)) + ".") for i, n in enumerate([9, 30, 55, 120, 12, 40])]
    filler = lambda n: " ".join(word() for _ in range(n))
    docs, want = [(100, None), (101, ""), (102, filler(400))], set()
    for k in range(60):
        i, t = items[k % 6]
        t = t.upper() if k % 5 == 0 else t.replace(" ", " ### ") if k % 5 == 1 else t.replace(". ", ".\n") if k % 5 == 2 else t
        docs.append((k, f"{filler(k * 3)} {t} {filler(50)}"))
        want.add((k, i))
        docs.append((1000 + k, f"{filler(k)} {' '.join(items[k % 6][1].split()[: len(items[k % 6][1].split()) // 2])} {filler(20)}"))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(0), "score": F.lit(0)})
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (92, "one")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = decontamination.contaminated(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and all(min(r.question_overlap, r.answer_overlap) >= 0.8 for r in got)
    kept = decontamination.keep_uncontaminated(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontamination.contaminated(frame, bench.limit(0)).count() == 0 and decontamination.contaminated(frame.limit(0), bench).count() == 0


@pytest.mark.parametrize("shard, held_bytes", [(4, 1), (20, 1 << 26)])
def test_leaks_over_many_shards(spark, monkeypatch, shard, held_bytes):
    """Some 50 shards, taken in turn for a few documents or for many at once: the same rows and scores as from one."""
    docs, bench = documents(spark), spark.read.parquet(f"{DATA}/benchmark.parquet")
    one = sorted(map(tuple, decontamination.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "SHARD", shard)
    assert decontamination.build_shards(bench)[1] == -(-bench.count() // shard)
    many = decontamination.contaminated(docs, bench, held_bytes).collect()
    assert sorted(map(tuple, many)) == one and len(one) == len(set(one))
    items = {r.item_id: decontamination.question_and_answer(r.text) for r in bench.collect()}
    want = set()
    for d in docs.collect():
        w = decontamination.terms(d.text)
        held = {n: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for n in range(1, 6)}
        for i, parts in items.items():
            shares = [sum(s in held[len(s)] for s in own) / len(own) for own in map(decontamination.shingles, parts)]
            if min(shares) >= 0.8:
                want.add((d.doc_id, i))
    assert {(r.doc_id, r.item_id) for r in many} == want and want
    kept = decontamination.keep_uncontaminated(docs, bench, held_bytes)
    assert kept.count() == docs.count() - len({d for d, _ in want}) and kept.columns == docs.columns


def test_leaks_in_odd_documents(spark):
    """Repeated rows, null ids and a very long text are reported as they come; columns of the same names don't disturb."""
    item = "one two three four five six seven eight nine ten. eleven twelve thirteen fourteen fifteen sixteen."
    long = " ".join(f"w{i % 5000}" for i in range(200_000))
    rows = [(1, item), (1, item), (None, item), (2, f"{long} {item} {long}"), (3, long), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(0) for c in ("item_id", "shard", "index", "a", "b", "n")})
    bench = spark.createDataFrame([(7, item), (7, item), (None, item), (8, None)], "item_id long, text string").withColumns({c: F.lit(0) for c in ("doc_id", "shard", "a", "n")})
    got = Counter((r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect())
    assert got == {(1, 7): 4, (1, None): 2, (None, 7): 2, (None, None): 1, (2, 7): 2, (2, None): 1}
    assert sorted(str(r.doc_id) for r in decontamination.keep_uncontaminated(docs, bench).collect()) == ["3", "4"]


def test_wand_equals_exhaustive_scores():
    r = random.Random(6)
    items = [(i, " ".join(r.choice("abcdef") + r.choice("xyz") for _ in range(r.randint(2, 40)))) for i in range(90)]
    index = decontamination.Index(items)
    for _ in range(200):
        query = sorted(r.sample(range(len(index.postings)), r.randint(1, 60)))
        score = Counter()
        for t in query:
            for slot, weight in index.postings[t].items():
                score[slot] += weight
        want = {s: x for s, x in score.items() if x >= index.threshold[s]}
        got = dict(index.retrieve(query))
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-9 for s in got)


# Pseudonyms

VALUES = {
    "email": ["jo.smith+x@mail.example.com", "é.90@mail2.example.com", "иван@mail.example.com", "li.王@x.org", "ΑΒγ_9@почта.рф", "ß@x.de", "a@b.co"],
    "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    "phone": ["+1 (017) 555-7713", "(212) 555-0199"],
    "card": ["4845168114407329", "4111 1111 1111 1111"],
    "ip": ["97.51.17.173", "0.0.0.0"],
    "ssn": ["123-45-6789", "899-99-9999"],
    "date": ["2024-02-29", "31.12.1999", "12/25/2020", "03/04/2021"],
}
LEFT = ["9807915762804490", "300.1.1.1", "1.2.3", "2023-02-30", "000-12-3456", "666-12-3456", "DE00370400440532013000", "v1.2.3.4.5", "0000000000000000", "12345"]


@pytest.mark.parametrize("kind", VALUES)
def test_pseudonyms_keep_format_and_turn_back(kind):
    for value in VALUES[kind]:
        text = f"before {value}, after {value}. {value}"
        new, found = pii.rewrite(text, KEY)
        assert found == {kind: 3} and value not in new
        own = new.removeprefix("before ").split(",")[0]
        assert new == f"before {own}, after {own}. {own}"
        if kind != "ip":
            assert [c.isdigit() for c in own] == [c.isdigit() for c in value] and len(own) == len(value)
        assert pii.rewrite(own, KEY)[1] == {kind: 1}
        assert pii.rewrite(new, KEY, back=True)[0] == text
        assert pii.rewrite(text, b"other")[0] != new


def test_what_is_not_valid_stays():
    for value in LEFT:
        assert pii.rewrite(f"a {value} b", KEY) == (f"a {value} b", {})


def test_nothing_stays_in_place_and_letters_keep_their_class():
    for size in (2, 3, 26, 1000):
        there = [pii.permute(i, size, KEY, "k") for i in range(size)]
        assert sorted(there) == list(range(size)) and all(i != x for i, x in enumerate(there))
        assert [pii.permute(x, size, KEY, "k", back=True) for x in there] == list(range(size))
    import unicodedata

    for name in ("иван", "王", "Ωμέγα", "ñandú", "سلام", "ㄱ한", "İı", "ﬀ"):
        new = pii.permute_signs(name, "email", KEY, False)
        assert new != name and [unicodedata.category(c) for c in new] == [unicodedata.category(c) for c in name]
        assert pii.permute_signs(new, "email", KEY, True) == name
    assert pii.rewrite("_@x.org", KEY) == ("_@x.org", {})


def test_a_day_is_the_same_in_all_forms():
    import datetime

    for day in (datetime.date(2020, 12, 25), datetime.date(1999, 3, 4), datetime.date(2024, 2, 29)):
        forms = ["%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y", "%d/%m/%Y", "%d-%m-%Y"] + ["%m/%d/%Y"] * (day.day > 12)
        new = {datetime.datetime.strptime(pii.rewrite(day.strftime(f), KEY)[0], f).date() for f in forms}
        assert len(new) == 1 and new != {day}


def planted(r):
    """A value of each kind from its definition alone, with no pattern of the operator: what an independent finder would look for."""
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda s, n: "".join(r.choice(s) for _ in range(n))

    def card():
        body = r.choice("3456") + digits(14)
        total = sum(d if i % 2 else (2 * d if d < 5 else 2 * d - 9) for i, d in enumerate(map(int, reversed(body))))
        whole = body + str(-total % 10)
        return r.choice([whole, " ".join(whole[i : i + 4] for i in range(0, 16, 4)), "-".join(whole[i : i + 4] for i in range(0, 16, 4))])

    def iban():
        bank = digits(18)
        return f"DE{98 - int(bank + '131400') % 97:02d}{bank}"

    day = lambda: f"{r.randint(1, 28):02d}"
    month = lambda: f"{r.randint(1, 12):02d}"
    return {
        "email": lambda: f"{letters('abcxyzäéжш王', r.randint(1, 9))}.{letters('qwerty', 3)}@{letters('mnop', 5)}.example.{r.choice(['com', 'org', 'co.uk'])}",
        "iban": iban,
        "phone": lambda: r.choice([f"+1 {r.randint(200, 999)} {digits(3)} {digits(4)}", f"({r.randint(200, 999)}) {digits(3)}-{digits(4)}", f"+44 20 {digits(4)} {digits(4)}", f"+49 30 {digits(6)}", f"{r.randint(200, 999)}-{digits(3)}-{digits(4)}"]),
        "card": card,
        "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)),
        "ssn": lambda: f"{r.randint(1, 665):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}",
        "date": lambda: r.choice([f"{r.randint(1900, 2099)}-{month()}-{day()}", f"{day()}.{month()}.{r.randint(1900, 2099)}", f"{day()}/{month()}/{r.randint(1900, 2099)}"]),
    }


@pytest.mark.parametrize("kind", pii.KINDS)
def test_recall_of_planted_values(kind):
    """Of 400 values between words and signs all are found as their kind, none stays, and all turn back."""
    r = random.Random(kind)
    make = planted(r)[kind]
    for _ in range(400):
        value = make()
        text = r.choice(["seen {} today", "({})", "at: {}, then", "„{}“", "{}", "end {}."]).format(value)
        new, found = pii.rewrite(text, KEY)
        assert found == {kind: 1} and value not in new and pii.rewrite(new, KEY, back=True)[0] == text, text


def test_a_key_is_demanded(spark):
    spark.conf.unset(pii.KEY_SETTING)
    with pytest.warns(UserWarning, match="random key"):
        key = pii.session_key(spark)
    assert len(key) == 64 and pii.session_key(spark) == key
    spark.conf.set(pii.KEY_SETTING, "mine")
    assert pii.session_key(spark) == b"mine"


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 100, 1000):
        there = [pii.feistel(i, size, KEY, "k") for i in range(size)]
        assert sorted(there) == list(range(size)) and [pii.feistel(x, size, KEY, "k", back=True) for x in there] == list(range(size))


def test_all_dates_turn_back():
    import datetime

    days = [pii.FIRST + datetime.timedelta(i) for i in range(0, 73049, 997)]
    for form in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y", "%m/%d/%Y"):
        for d in days:
            text = d.strftime(form)
            assert pii.rewrite(pii.rewrite(text, KEY)[0], KEY, back=True)[0] == text


def test_pseudonyms_of_documents(spark):
    docs = edge_documents(spark).unionByName(edge_documents(spark).limit(1).withColumn("text", F.lit("x 4845168114407329")))
    new = pii.pseudonymize(docs, KEY)
    assert new.columns == docs.columns and new.schema.fieldNames() == docs.schema.fieldNames()
    back = pii.pseudonymize(new, KEY, back=True)
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.collect()))
    assert pii.pseudonymize(docs.select("doc_id", "text"), KEY, counts=True).agg(F.sum("n_card")).first()[0] == 1
    with pytest.raises(ValueError):
        pii.pseudonymize(docs.withColumn("n_card", F.lit(1)), KEY, counts=True)


# Tokens, packing, counts

SIGNS = "ab é\n\t .,'s#12½ \x1c\x85ªſ日<|>\xa0"


def library_ids(texts, plain=False):
    """By the unmodified library; plain: names of special tokens as text."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    if plain:
        t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("plain", [False, True])
def test_ids_equal_the_tokenizers(plain):
    r = random.Random(1)
    signs = [*SIGNS, "<|endoftext|>"]
    texts = ["".join(r.choice(signs) for _ in range(r.randint(0, 16))) for _ in range(4000)]
    texts += ["hello <|endoftext|> world", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "x <|endoftext|>y", "don't we'll I'd", "   ", "日本 語 x", None]
    got = [np.frombuffer(x, "<u4").tolist() for x in tokens.Encoder(tokens.default_path(), plain=plain, cached=100).encode(texts)]
    assert got == library_ids(texts, plain) and (50256 in got[4000]) != plain


def test_packing(spark):
    docs = edge_documents(spark)
    rows = packing.pack(docs, keep_ids=True).collect()
    want = sorted((str(i), tuple(ids + [0])) for (i, _), ids in zip(EDGES, library_ids([t for _, t in EDGES])))
    assert sum(r.length for r in rows) == sum(len(ids) for _, ids in want)
    lengths = {}
    for r in rows:
        assert len(r.ids) == r.length <= 2048 and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and (r.piece == 0 or r.length == 2048)
        lengths.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in lengths.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    long = sorted((r for r in rows if r.doc_id == 14), key=lambda r: r.piece)
    assert len(long) > 1 and tuple(x for r in long for x in r.ids) == next(ids for i, ids in want if i == "14") and [r.start for r in long] == list(np.cumsum([0] + [r.length for r in long[:-1]]))
    assert packing.pack(docs.limit(0)).count() == 0


def best_bins(sizes, capacity):
    best = [len(sizes)]

    def go(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(sizes):
            best[0] = len(rooms)
            return
        for i in sorted(set(range(len(rooms))), key=lambda i: rooms[i]):
            if rooms[i] >= sizes[k]:
                go(k + 1, rooms[:i] + [rooms[i] - sizes[k]] + rooms[i + 1 :])
        go(k + 1, rooms + [capacity - sizes[k]])

    go(0, [])
    return best[0]


def test_reduction_never_costs_a_sequence():
    """What is fixed, with an optimal packing of the rest, is optimal for the whole."""
    r = random.Random(9)
    for _ in range(300):
        sizes = sorted((r.randint(1, 20) for _ in range(r.randint(1, 8))), reverse=True)
        counts = dict(Counter(sizes))
        fixed = packing.reduce_dominated(counts, 20)
        rest = sorted((x for x, n in counts.items() for _ in range(n)), reverse=True)
        assert sum(n for _, n in fixed) + (best_bins(rest, 20) if rest else 0) == best_bins(sizes, 20), sizes
        steps = packing.plan(Counter(sizes), 20)
        assert sorted(Counter(steps[:, 0]).keys()) == sorted(set(sizes))


def test_token_counts(spark):
    named = edge_documents(spark).limit(1).withColumns({"doc_id": F.lit(77).cast("long"), "text": F.lit("a <|endoftext|> b")})
    want = Counter(zip([*(str(i) for i, _ in EDGES), "77"], map(len, library_ids([*(t for _, t in EDGES), "a <|endoftext|> b"], plain=True))))
    got = token_counts.document_token_counts(edge_documents(spark).unionByName(named)).collect()
    assert all(r.ended for r in got) and Counter((str(r.doc_id), r.n_tokens) for r in got) == want
    assert token_counts.document_token_counts(named.limit(0)).count() == 0


@pytest.mark.parametrize("block", [2, 4, 10, 64, 1 << 20])
def test_separators_are_stitched_across_ranges(spark, tmp_path, block):
    files = {"a.bin": [3, 0, 1], "b.bin": [7], "c.bin": [0, 0, 12, 1], "long.bin": [500, 3, 0, 900]}
    (tmp_path / "f").mkdir()
    for name, counts in files.items():
        ids = [x for n in counts for x in [*range(1, n + 1), 50256]] + ([5, 6] if name == "c.bin" else [])
        (tmp_path / "f" / name).write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "f" / "empty.bin").write_bytes(b"")
    if block == 2 or block == 4:
        files.pop("long.bin")
        (tmp_path / "f" / "long.bin").unlink()
    found = token_counts.count_tokens(spark, str(tmp_path / "f"), block=block)
    got = sorted((r.file.rsplit("/", 1)[-1], r.doc_no, r.start, r.n_tokens, r.ended) for r in found.collect())
    want = []
    for name, counts in files.items():
        start = 0
        tail = [2] if name == "c.bin" else []
        for k, n in enumerate(counts + tail):
            want.append((name, k, start, n, k < len(counts)))
            start += n + 1
    assert got == sorted(want)


def test_files_are_bounded_by_bytes_and_ranges_read_by_several_tasks(spark, tmp_path):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.expr("repeat('word ', 50 + cast(id % 9 as int))").alias("text")).coalesce(1)
    index = token_counts.write_flat(docs, str(tmp_path / "f"), file_bytes=2000)
    sizes = {p.name: p.stat().st_size for p in (tmp_path / "f").iterdir()}
    assert len(sizes) > 8 and max(sizes.values()) < 2000 + 400
    assert index.select("file").distinct().count() == len(sizes)
    one = token_counts.write_flat(docs, str(tmp_path / "g"))
    assert one.select("file").distinct().count() == 1
    assert token_counts.ranges(spark, str(tmp_path / "g"), 1000).count() > 10
    got = {r.doc_no: r.n_tokens for r in token_counts.count_tokens(spark, str(tmp_path / "g"), block=1000).collect()}
    assert got == {r.doc_no: len(x) for r, x in zip(sorted(one.collect(), key=lambda r: r.doc_no), library_ids([r.text for r in docs.orderBy("doc_id").collect()]))}
    (tmp_path / "g" / "odd.bin").write_bytes(b"123")
    with pytest.raises(Exception, match="odd number of bytes"):
        token_counts.count_tokens(spark, str(tmp_path / "g")).collect()


# Classifier


def test_classifier_on_held_out_labels(spark):
    big = DATA.parent / "sf0.01"
    if not big.exists():
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    scores = classifier.quality_scores(docs, labels)
    rows = scores.join(labels, "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows)
    assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.9
    blind = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sorted(scores.collect()) == sorted(classifier.quality_scores(docs, blind).collect())


def auc(scores, labels):
    pairs = sorted(zip(scores, labels))
    rank, total = {}, 0
    for i, (x, _) in enumerate(pairs, 1):
        rank.setdefault(x, []).append(i)
    total = sum(sum(rank[x]) / len(rank[x]) for x, y in pairs if y)
    ones = sum(labels)
    return (total - ones * (ones + 1) / 2) / (ones * (len(labels) - ones))


def test_classifier_is_calibrated_and_beats_a_plain_baseline(spark):
    """On held-out rows: scores are near the share of good texts that have them, and rank better than naive Bayes on words."""
    big = DATA.parent / "sf0.1"
    if not big.exists():
        pytest.skip("no test tables here")
    import math

    docs, labels = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    found = {r.doc_id: (r.score, r.quality) for r in classifier.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").collect()}
    bins = {}
    for score, y in found.values():
        bins.setdefault(min(9, int(score * 10)), []).append((score, y))
    error = sum(abs(sum(s for s, _ in b) - sum(y for _, y in b)) for b in bins.values()) / len(found)
    counts = [Counter(), Counter()]
    texts = {r.doc_id: (r.text or "").split() for r in docs.join(labels, "doc_id").collect()}
    for r in labels.collect():
        if r.doc_id in texts and r.doc_id not in found:
            counts[int(r.quality)].update(set(texts[r.doc_id]))
    weight = {w: math.log((counts[1][w] + 1) / (counts[0][w] + 1)) for w in counts[0] | counts[1]}
    plain = [sum(weight.get(w, 0.0) for w in set(texts[i])) for i in found]
    own = auc([s for s, _ in found.values()], [y for _, y in found.values()])
    assert error < 0.05 and own > 0.97 and own > auc(plain, [y for _, y in found.values()]) - 0.005


def test_temperature_calibrates():
    """Labels drawn with noise: the temperature brings the mean score of confident rows to their share of ones."""
    r = np.random.default_rng(5)
    x = r.normal(size=(4000, 2 * classifier.SIZE + 2))
    p = 1 / (1 + np.exp(-2 * x[:, 0]))
    y = (r.random(4000) < p).astype(float)
    net = classifier.fit(x, y)
    fresh = r.normal(size=(4000, x.shape[1]))
    truth = 1 / (1 + np.exp(-2 * fresh[:, 0]))
    scores = net.scores(fresh)
    cold = 1 / (1 + np.exp(-net.logits(fresh)))
    assert net.temperature > 1 and np.abs(scores - truth).mean() < np.abs(cold - truth).mean()


def test_classifier_on_odd_tables(spark):
    docs = edge_documents(spark)
    labels = spark.createDataFrame([(1, 1), (3, None), (10, 0), (None, 1)], "doc_id long, quality int").withColumn("x", F.lit(1))
    rows = classifier.quality_scores(docs, labels).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    for some in (labels.limit(0), labels.where("quality = 1")):
        assert len({r.score for r in classifier.quality_scores(docs, some).collect()}) == 1
    assert classifier.quality_scores(docs.limit(0), labels).count() == 0


def test_blocks_of_sums_travel_unchanged():
    sums = np.random.default_rng(1).integers(-(2**40), 2**40, (classifier.BLOCKS, 32))
    sums[3], sums[5, 0] = 0, -1
    got = {i: classifier.unpacked(x) for i, x in zip(*(c.to_pylist() for c in classifier.packed(sums).columns))}
    assert 3 not in got and all(np.array_equal(got[i], sums[i]) for i in got) and len(got) == classifier.BLOCKS - 1


def test_pooling_takes_long_texts_piecewise(monkeypatch):
    vectors = np.random.default_rng(0).normal(size=(classifier.BUCKETS, classifier.SIZE)).astype(np.float32)
    text = " ".join(f"w{i % 77}" for i in range(1000))
    whole = classifier.pooled(text, classifier.Buckets(), vectors)
    monkeypatch.setattr(classifier, "PIECE", 64)
    assert np.allclose(whole, classifier.pooled(text, classifier.Buckets(), vectors), atol=1e-4)


# HTML


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "low": F.lit(1), "text": F.lit("t")})


def test_main_text(spark):
    page = (
        '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body><nav><ul><li>menu</li></ul></nav><!-- <p>c</p> -->'
        '<div class="ad">buy</div><header>site</header><article><h1>Head &amp; line</h1><p><b>One<br><p>Two\n  &lt;x&gt; &eacute;</p><ul><li>a<li>b</ul>'
        '<aside>side</aside><form>f<input></form><section id="comments"><p>reader</p></section><div>plain <i>text</i></div></article><footer>&copy; f</footer>'
    )
    rows = [(1, "https://a.example.com/1", page), (1, "https://a.example.com/1", page), (2, None, None), (3, "x", ""), (None, "https://b/", "<p>bare</p>"), (4, "https://b/2", "no markup")]
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in html.extract(pages_of(spark, rows)).collect()}
    text = "Head & line\nOne\nTwo <x> é\na\nb\nplain text"
    assert got[1, "https://a.example.com/1"] == (text, len(text)) and got[2, None] == ("", 0) and got[3, "x"] == ("", 0)
    assert got[None, "https://b/"][0] == "bare" and got[4, "https://b/2"][0] == "no markup"
    assert html.extract(pages_of(spark, rows)).count() == 6 and html.extract(pages_of(spark, rows).limit(0)).count() == 0


def test_odd_markup():
    cases = {
        '<article><div class="article-header"><h1>T</h1></div><div class="ad-slot">x</div><article class="comment"><p>c</p></article><p>a</p></article>': "T\na",
        '<article><p title="x>y">a</p><p title="open>b</p><p>1 < 2 <3</p></article>': "a\nb\n1 < 2 <3",
        "<article>a &amp;lt; b&nbsp;c<br/>d<!-- > --><p>e</article": "a &lt; b c d\ne",
        "<div role=navigation>m</div><div class='cookie-notice'>k</div><main>t</main>": "t",
        "<ARTICLE><P>A<SCRIPT>if (a < b) {'<p>'}</SCRIPT>B</P></ARTICLE>": "AB",
    }
    for page, text in cases.items():
        assert html.main_text(page, {}) == text, page


def test_style_tree_cuts_what_a_site_repeats(spark):
    """Without an article element, the branch that reads the same on all pages goes; on another host the same branch varies and stays."""
    rows = [(i, f"https://same.example.com/{i}", f"<body><div id='top'><span>Welcome to us</span></div><div id='body'><p>text {i} {i * 7}</p><p>more {i}</p></div></body>") for i in range(30)]
    rows += [(100 + i, f"https://varies.example.com/{i}", f"<body><div id='top'><span>Story {i}</span></div><div id='body'><p>text {i * 3}</p></div></body>") for i in range(30)]
    got = {r.page_id: r.text for r in html.extract(pages_of(spark, rows)).collect()}
    assert got[3] == "text 3 21\nmore 3" and got[103] == "Story 3\ntext 9"
    copies = [(i, "https://copies.example.com/", "<body><div id='body'><p>the same</p></div></body>") for i in range(20)]
    assert {r.text for r in html.extract(pages_of(spark, copies)).collect()} == {"the same"}


def story(i, n):
    return "<article><h1>Title %d</h1>%s</article>" % (i, "".join(f"<p>part {k} of {i}</p>" for k in range(n)))


def test_style_tree_decides_inside_and_beside_articles(spark):
    """A notice that a site repeats in its articles goes, a branch beside them that varies stays; small sites follow the prior."""
    page = "<body><div><p>About %s</p></div>%s<div><ul><li>fixed</li></ul></div></body>"

    def rows(site, n, first):
        return [(first + i, f"https://{site}/{i}", page % (i, story(i, 1 + i % 7).replace("</h1>", "</h1><div>Read our letter</div>"))) for i in range(n)]

    got = {r.page_id: r.text.split("\n") for r in html.extract(pages_of(spark, rows("large", 400, 0) + rows("small", 5, 1000))).collect()}
    assert got[9] == ["About 9", "Title 9", "part 0 of 9", "part 1 of 9", "part 2 of 9"]
    assert got[1002] == ["Title 2", "Read our letter", "part 0 of 2", "part 1 of 2", "part 2 of 2"]
    copies = [(i, "https://copies/", page % (0, story(0, 3))) for i in range(300)] + [(999, "https://copies/", page % (0, story(1, 2)))]
    got = {r.page_id: r.text for r in html.extract(pages_of(spark, copies)).collect()}
    assert got[5] == "Title 0\npart 0 of 0\npart 1 of 0\npart 2 of 0" and got[999] == "Title 1\npart 0 of 1\npart 1 of 1"


def test_importance_equals_brute_force(spark):
    """Merged plainly, page by page, entropies from their definition; broadcast and dealt lists give the same texts."""
    import math

    r = random.Random(3)
    rows = []
    for i in range(240):
        site = r.choice(["a.example.com", "a.example.com", "b.example.com", "c.example.org"])
        beside = r.choice(["", f"<div class='box'><p>{r.choice('xyz')}</p></div>", "<section><p>same</p><p>again</p></section>"])
        rows.append((i, f"https://{site}/{i}", f"<body>{beside}{story(r.randrange(90), r.randint(1, 4)) if r.random() < 0.8 else '<div><p>t%d</p></div>' % r.randrange(40)}</body>"))
    pages = pages_of(spark, rows)
    seen = {}
    for _, url, page in rows:
        for node, kind, feature in html.features(page):
            seen.setdefault((html.host(url), node), [Counter(), Counter(), Counter()])[kind][feature] += 1

    def entropy(counts):
        total = sum(counts.values())
        return 1.0 if total == 1 else -sum(n / total * math.log(n / total) for n in counts.values()) / math.log(total)

    want = {k: (sum(c[0].values()), entropy(c[1]), entropy(c[2])) for k, c in seen.items()}
    best = {s: max((p + c) / 2 for (site, _), (_, p, c) in want.items() if site == s) for s, _ in want}
    got = {(x.host, x.node): (x.pages, x.presentation, x.content, x.branch) for x in html.importance(pages).collect()}
    assert got.keys() == want.keys()
    for k, (m, p, c) in want.items():
        assert got[k] == pytest.approx((m, p, c, (p + c) / 2 / best[k[0]] if best[k[0]] else 1), abs=1e-9)
    texts = [sorted(map(tuple, html.extract(pages, most_nodes=n).collect())) for n in (10**6, -1)]
    assert texts[0] == texts[1]


def test_very_long_pages_and_copies_of_a_host(spark):
    """A page of 20,000 blocks under 300 nested elements; 200 copies of one page; a page that never ends a tag."""
    deep = "<div>" * 300 + "<article>" + "".join(f"<p>block {i} &amp; more</p>" for i in range(20_000)) + "</article>" + "</div>" * 300
    rows = [(0, "https://a/0", deep)] + [(i, "https://a/1", story(1, 3)) for i in range(1, 201)] + [(201, "https://a/2", "<article><p>open " + "x " * 100_000)]
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(pages_of(spark, rows)).collect()}
    assert got[0][0] == "\n".join(f"block {i} & more" for i in range(20_000)) and got[0][1] == len(got[0][0])
    import time

    began = time.perf_counter()
    broken = "<div>x" * 30_000 + "<article>" + "<div>y" * 30_000
    assert html.main_text(broken, {}) == "\n".join(["y"] * 30_000) and len(html.features(broken)) == 3 * 60_001 and time.perf_counter() - began < 20
    assert {got[i][0] for i in range(1, 201)} == {"Title 1\npart 0 of 1\npart 1 of 1\npart 2 of 1"} and got[201][0] == "open " + ("x " * 100_000).strip()


def test_large_hosts_are_dealt_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(html, "HOST_PAGES", 10)
    rows = [(i, "https://hot.example.com/", f"<p>{i}</p>") for i in range(100)] + [(200, "https://x/", "<p>x</p>"), (None, None, None)]
    pages = pages_of(spark, rows).withColumn("host", F.expr("coalesce(regexp_extract(url, '//([^/]*)', 1), '')"))
    nodes = spark.createDataFrame([("hot.example.com", 1, 1), ("hot.example.com", 2, 4), ("x", 3, 2)], "host string, node long, bits int")
    got = html.with_bits(pages.drop("bits"), nodes, most_nodes=0).collect()
    assert len(got) == 102 and all(len(r.bits) == 2 for r in got if r.host == "hot.example.com") and [r.bits for r in got if r.page_id is None] == [None]


def test_pages_table(spark):
    import re
    from html import unescape

    if not DATA.exists():
        pytest.skip("no test tables here")
    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = re.search("<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split("</?(?:h1|p)>", re.sub("</?b>", "", article).replace("<br>", " "))
        assert got[r.page_id] == "\n".join(t for t in (re.sub(r"\s+", " ", unescape(b)).strip() for b in blocks) if t)


# The pipeline


def brute_pipeline(docs, bench):
    """ids of documents that stay, by plain code: DuckDB's verdicts, all pairs of fingerprints, all shingles of all items."""
    import duckdb

    from forecourt.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    good = {r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.ORACLES['op2_quality_rules']}) WHERE kept").fetchall()}
    texts = {i: t for i, t in docs.items() if i in good}
    label = brute.components(sorted((i, brute.simhash(t)) for i, t in texts.items()))
    texts = {i: t for i, t in texts.items() if label[i] == i}
    clean = {}
    for i, t in texts.items():
        w = decontamination.terms(t)
        held = {n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} for n in range(1, 6)}
        parts = ([decontamination.shingles(p) for p in decontamination.question_and_answer(x)] for x in bench)
        if not any(all(own and sum(s in held[len(s)] for s in own) >= 0.8 * len(own) for own in p) for p in parts):
            clean[i] = t
    return clean


def test_pipeline(spark):
    import corpus_pipeline

    documents(spark)
    spark.conf.set(pii.KEY_SETTING, "test")
    rows = corpus_pipeline.run(spark, str(DATA)).collect()
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, kept, str(DATA))
        assert new.columns == docs.columns and new.dtypes == docs.dtypes
        kept = common.materialize(new, "stage")
    bench = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    texts = brute_pipeline({r.doc_id: r.text for r in docs.collect()}, bench)
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {i: (x, len(x)) for i, t in texts.items() for x in [pii.rewrite(t, b"test")[0]]}
    assert {r.doc_id for r in rows} == set(texts) and 0 < len(texts) < docs.count()
    want = {i: x + [0] for i, x in zip(texts, library_ids(pii.rewrite(t, b"test")[0] for t in texts.values()))}
    for i, x in want.items():
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [k for r in own for k in r.ids] == x
        assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.ids == x[r.start : r.start + r.length] for r in own)
    # No packing has fewer sequences than the ids fill; best fit alone isn't better.
    lengths = Counter(r.length for r in rows)
    n = len({r.sequence_id for r in rows})
    alone = sum(m for _, m in packing.best_fit(dict(lengths), 2048))
    assert -(-sum(r.length for r in rows) // 2048) <= n <= alone
    assert corpus_pipeline.unique(spark, docs.limit(0), str(DATA)).count() == 0 and PROSE


def test_stages_keep_odd_columns_and_rows(spark):
    """Maps, names of inner columns and of SQL, repeated and null ids, a very long text: all but the last stage return them as they came."""
    import corpus_pipeline

    documents(spark)
    rows = [(1, PROSE, {"a": 1}), (1, PROSE + " zeta eta theta iota kappa lambda", {"a": 2}), (None, PROSE[::-1], None), (2, None, {}), (3, "".join(f"The word{i} of story{i}. " for i in range(40_000)), {})]
    docs = spark.createDataFrame(rows, "doc_id long, text string, meta map<string, int>")
    docs = docs.withColumns({c: F.lit(1) for c in ("row", "doc", "_row", "fp", "n", "a.b", "select", "w", "lines", "n_words")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, str(DATA))
        assert new.columns == docs.columns and new.dtypes == docs.dtypes
        assert {r.doc_id for r in new.collect()} >= {1, 3}
        assert stage(spark, docs.limit(0), str(DATA)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(DATA)).select("doc_id").distinct().count() == 4


@pytest.mark.parametrize(
    "before, after",
    [
        ('<body class="has-sidebar">', "</body>"),
        ('<html class="no-ad"><body class="comments-open search">', "</body></html>"),
        ('<body><div class="layout-no-sidebar">', "</div></body>"),
        ('<div id="search-results">', "</div>"),
        ('<div class="widget sidebar"><div role="search">', "</div></div>"),
        ('<form id="page">', "</form>"),
        ('<main class="search"><div class="widget">', "</div></main>"),
    ],
)
def test_marked_wrappers_keep_their_article(before, after):
    page = f'<div class="sidebar">side</div>{before}<nav>menu</nav><article class="post widget"><p>The story.</p><div class="share">s</div><div class="ad-slot">a</div></article>{after}'
    assert html.main_text(page, {}) == "The story."


def test_marks_inside_articles_and_compounds():
    page = '<main><article><p>A</p><div class="comments"><article>c</article></div></article><div class="related-posts"><article>r</article></div></main>'
    assert html.main_text(page, {}) == "A"
    assert html.main_text('<div class="layout-no-sidebar"><p>A</p><div class="site-footer">f</div><div class="ad-300">a</div></div>', {}) == "A"


def test_cards_beside_other_numbers():
    card, r = "4111 1111 1111 1111", random.Random(5)
    texts = [f"card {card} 12/27", "4111111111111111 123", f"no 7 {card}", f"{card} 12/12/2027", f"12 34 56 78 {card}", f"{card} 3782 822463 10005", f"{card} 555-123-4567", "4111-1111-1111-1111 99"]
    for text in texts:
        new, found = pii.rewrite(text, KEY)
        assert found["card"] >= 1 and not {card, card.replace(" ", ""), card.replace(" ", "-")} & {new[i : i + n] for n in (16, 19) for i in range(len(new))}
        assert pii.rewrite(new, KEY, back=True)[0] == text
    for _ in range(1500):
        text = "".join(r.choice(["7", "12", "123", "4", "5500 0000 0000 0004", "4111111111111111", card, "1234 5678", "2024-02-29", "555-123-4567"]) + r.choice([" ", "-", " "]) for _ in range(r.randint(1, 8))) + "x"
        assert pii.rewrite(pii.rewrite(text, KEY)[0], KEY, back=True)[0] == text
    assert pii.rewrite("1 2 3 4 5 6 7 8 9 10 11 12 13 14 16", KEY) == ("1 2 3 4 5 6 7 8 9 10 11 12 13 14 16", {})


@pytest.mark.parametrize("value", ["+44 20 7946 0958", "+33 1 23 45 67 89", "555-123-4567", "+49 30 12345678", "+34 912 34 56 78", "+44 (0)20 7946 0958", "+353 87 123 4567"])
def test_phones_of_other_groupings(value):
    text = f"call {value}, or {value} now"
    new, found = pii.rewrite(text, KEY)
    assert found == {"phone": 2} and value not in new and pii.rewrite(new, KEY, back=True)[0] == text
    assert [c.isdigit() for c in new] == [c.isdigit() for c in text]


def test_runs_of_digits_too_long_for_a_card_stay():
    r = random.Random(6)
    for _ in range(50):
        text = "".join(r.choice("0123456789") for _ in range(r.randint(20, 40)))
        assert pii.rewrite(text, KEY) == (text, {})


def changed(words, i, how):
    return words[:i] + {"other": ["zzz"], "gone": [], "more": [words[i], "zzz"]}[how] + words[i + 1 :]


@pytest.mark.parametrize("n_question, n_answer", [(9, 6), (30, 2), (60, 1), (12, 8), (6, 30), (40, 5), (3, 9)])
def test_items_with_one_word_changed_are_found(n_question, n_answer):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(3, 6)))
    filler = lambda n: [word() for _ in range(n)]
    items = [(k, f"{' '.join(filler(n_question))}. {' '.join(filler(n_answer))}.") for k in range(5)]
    searcher = decontamination.Searcher(decontamination.Index(items))
    own = decontamination.terms(items[2][1])
    for part, size in ((n_question, n_answer), (0, n_question)):
        for i in {part, part + size // 2, part + size - 1}:
            for how in ("other", "gone", "more"):
                text = " ".join(filler(90) + changed(own, i, how) + filler(90))
                assert [x[0] for x in searcher.leaks(text)] == [2], (i, how)
    half = " ".join(filler(50) + own[: len(own) // 2] + filler(50))
    shuffled = " ".join(r.sample(own, len(own)))
    assert searcher.leaks(half) == [] and searcher.leaks(shuffled) == [] and searcher.leaks(" ".join(filler(300))) == []


def test_one_row_of_each_group_stays_whatever_its_id(spark):
    texts = [" ".join(f"{k}w{i}" for i in range(60)) for k in "abcde"]
    a, b, c, d, e = texts
    rows = [(1, a), (1, b), (1, c), (2, b), (3, d), (None, d), (None, e), (None, e), (None, a), (4, c), (1, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"fp": F.lit(0), "label": F.lit(0)}).repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", a), ("1", b), ("1", c), ("3", d), ("None", e)])
    near = spark.createDataFrame([(7, "z " + a), (7, b), (8, "z " + a), (9, c), (7, "y " + c)], "doc_id long, text string")
    pairs = brute.components(list(enumerate(brute.simhash(t) for _, t in near.collect())))
    got = [(r.doc_id, r.text) for r in simhash.keep_one(near).collect()]
    assert len(got) == len(set(pairs.values())) and (7, b) in got and (7, "z " + a) in got and (8, "z " + a) not in got
