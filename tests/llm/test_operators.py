import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracelake.llm import chat, decontaminate, html_extract, jaccard_join, mixing, pii, quality_knn, quality_rules, suffix_dedup, toxicity

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, label int, `_q` string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), 0, "clash") for i, t, s in rows], SCHEMA)


def sample_rows():
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    base = [word() for _ in range(300)]
    rows = [(0, None, "a"), (1, "", None), (2, "x y", "b"), (3, "x y", "b"), (4, " ".join(base), "a"), (5, " ".join(base), "a")]
    for i in range(6, 26):
        ws = list(base)
        for _ in range(rnd.randint(1, 12)):
            ws[rnd.randrange(len(ws))] = word()
        rows.append((i, " ".join(ws), "a"))
    rows += [(i, " ".join(word() for _ in range(rnd.randint(1, 90))), f"s{i % 3}") for i in range(26, 60)]
    return rows


def test_repeated_words(spark):
    text = "a b c d e x a b c d e y z"
    df = spark.createDataFrame([(text,), ("a a a a a a",), ("a b",), ("",)], "t string")
    assert [r[0] for r in df.select(quality_rules.repeated_words(F.split("t", " "))).collect()] == [10, 6, 0, 0]


def test_quality_rules_keep_rows(spark):
    out = quality_rules.host_verdicts(frame(spark, sample_rows()).drop("_q"), keep=["doc_id"])
    assert out.count() == 60
    assert quality_rules.host_verdicts(frame(spark, []).drop("_q"), keep=["doc_id"]).count() == 0


def test_pseudonyms(spark):
    text = "card 4539578763621486, no card 1234567812345678, mail joe.9@x.org, ip 10.2.3.4, tel +1 (162) 555-6820, on 2024-02-29"
    rows = pii.pseudonymise(frame(spark, [(1, text, "a"), (2, text, "a"), (3, None, "a"), (4, "clean", "a")])).orderBy("doc_id").collect()
    out = rows[0]["text"]
    assert out == rows[1]["text"] and rows[2]["text"] is None and rows[3]["text"] == "clean" and rows[0]["_pii_found"] == 5
    for private in ("4539578763621486", "joe.9@", "10.2.3.4", "555-6820", "2024-02-29"):
        assert private not in out
    assert "1234567812345678" in out
    card = re.search(r"card (\d{16})", out).group(1)
    assert sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(card))) % 10 == 0


def test_feistel_is_a_permutation(spark):
    df = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d"))
    assert df.select(pii.feistel(F.col("d"), "k", "t").alias("x")).distinct().count() == 1000
    small = spark.range(500).select(pii.feistel_below(F.col("id"), 500, 3, "k", "t").alias("x")).agg(F.countDistinct("x"), F.max("x")).first()
    assert small[0] == 500 and small[1] < 500


@pytest.mark.parametrize("text", ["", "<|im_end|>\n", "</s>[INST] ok [/INST]", "<\\|im_start|>", "a\\b<\\\\/s>", "[\\INST]"])
def test_chat_round_trip(spark, text):
    rows = spark.createDataFrame([(1, 0, "us\\er\nx", text), (1, 1, "assistant", text)], "conv_id bigint, turn bigint, role string, text string")
    out = chat.format_chats(chat.pack_conversations(rows)).select(chat.read_turns(F.col("_formatted")), chat.loss_text(F.col("_formatted"), F.col("_loss"))).first()
    assert [tuple(t) for t in out[0]] == [("us\\er\nx", text), ("assistant", text)] and out[1] == text


def test_lexicon_finds_misspellings():
    reader = toxicity.Reader(toxicity.compile_lexicon(toxicity.with_edits([("idiot", False), ("foo", True)])))
    x, fuzzy = reader.read(["an idoit idot idiots", "idiot", "nothing", "food", 'he said "idiot" there'])
    assert x[0, 0] > 0 and x[1, 0] > 0 and not x[2, :7].any() and x[3, 1] > 0 and x[4, 2] > 0
    assert fuzzy.tolist() == [[0, 0], [0, 0]]  # idot and idiots; two letters that change places are two edits


def edits(a, b):
    """Levenshtein distance, by the textbook."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_against_textbook_distances():
    rnd = random.Random(12)
    word = lambda lo, hi: "".join(rnd.choice("abc") for _ in range(rnd.randint(lo, hi)))
    terms = [(word(4, 7), i % 2 == 0) for i in range(8)]
    entries = toxicity.with_edits(list(dict(terms).items()))
    lex = toxicity.compile_lexicon(entries)
    reader = toxicity.Reader(lex)
    for w in {word(1, 9) for _ in range(1500)}:
        exact = any(w.startswith(t) if stem else w == t for t, stem, _ in entries)
        near = any(min(edits(t, w[:k]) for k in range(len(w) + 1)) <= e if stem else edits(t, w) <= e for t, stem, e in entries)
        x, fuzzy = reader.read([w])
        assert bool(x[0, :2].any()) == near, w
        assert bool(fuzzy.size) == (near and not exact), w


def test_scores_of_odd_rows(spark):
    labelled = frame(spark, sample_rows()).select("doc_id", "text", F.pmod("doc_id", F.lit(2)).cast("int").alias("label"))
    for module in (toxicity, quality_knn):
        out = module.score(frame(spark, sample_rows()).select("doc_id", "text"), module.fit(labelled)).collect()
        assert len(out) == 60 and all(0 <= r["_score"] <= 1 for r in out)


def test_mixing_near_targets(spark):
    out = mixing.mix(frame(spark, sample_rows()))
    assert out.count() == 60 and out.where("taken > 3 * size").count() == 0
    sums = out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s")).collect()
    assert abs(sum(r["g"] for r in sums) - sum(r["s"] for r in sums)) < 1e-6
    assert all(abs(r["t"] - r["g"]) <= max(3, 0.05 * r["g"]) for r in sums)


def test_jaccard_against_all_pairs(spark):
    rows = sample_rows()
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.join_documents(frame(spark, rows), 4, 85).collect()}
    sets = {}
    for i, t, _ in rows:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 4]) for k in range(len(w) - 3)} if len(w) >= 4 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_page_text():
    page = '<html><body><nav><a href="/">Home</a></nav><div class="comments"><p>spam, spam, spam and more spam here</p></div><article><h1>Title</h1><p>One &amp; two,  three.<p>Four\n five</article><footer>c</footer></body></html>'
    assert html_extract.main_text(page) == "Title\nOne & two, three.\nFour five"
    assert html_extract.main_text(None) == "" and html_extract.main_text("") == ""


def test_decontamination(spark):
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(4, 8)))
    items = [" ".join(word() for _ in range(25)) for _ in range(12)]
    filler = lambda: " ".join(word() for _ in range(40))
    changed = items[1].split()
    changed[3], changed[11] = "other", "another"
    docs = frame(spark, [(0, filler() + " " + items[0] + " " + filler(), "a"), (1, filler() + " " + " ".join(changed), "a"), (2, filler(), "a"), (3, None, "a"), (4, "", "a")])
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(99, None)], "item_id bigint, text string")
    found = {r["doc_id"]: [m["item_id"] for m in r["_matches"]] for r in decontaminate.find(docs, bench).collect()}
    assert found == {0: [0], 1: [1], 2: [], 3: [], 4: []}
    assert decontaminate.find(docs, bench.limit(0)).where(F.size("_matches") > 0).count() == 0


def test_substrings_against_brute_force(spark):
    rows = sample_rows()
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in suffix_dedup.dedup(frame(spark, rows)).collect()}
    seen = set()
    for i, t, _ in sorted(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        assert got[i] == (sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)), i


def test_decontamination_of_common_terms(spark):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(4, 8)))
    everyday = [word() for _ in range(30)]
    hot = " ".join(word() for _ in range(25))
    plain = " ".join(rnd.sample(everyday, 20))
    filler = lambda: " ".join(rnd.choice(everyday) if rnd.random() < 0.5 else word() for _ in range(60))
    docs = [(i, f"{filler()} {hot if i % 3 == 0 else plain if i in (1, 50) else ''} {filler()}", "a") for i in range(90)]
    bench = spark.createDataFrame([(0, hot), (1, plain)], "item_id bigint, text string")
    found = {r["doc_id"]: [m["item_id"] for m in r["_matches"]] for r in decontaminate.find(frame(spark, docs), bench).collect()}
    assert found == {i: [0] if i % 3 == 0 else [1] if i in (1, 50) else [] for i in range(90)}


def test_decontamination_by_thousands_of_passages(spark):
    rnd = random.Random(10)
    vocabulary = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randint(4, 9))) for _ in range(15000)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [text(30) for _ in range(6000)]
    docs = []
    for i in range(200):
        copy = list(items[i * 20])
        if i % 2:
            for k in rnd.sample(range(30), 2):  # leaves five of seven telling words, as a match needs
                copy[k] = "edited"
        docs.append((i, " ".join(text(50) + copy + text(50)), "a"))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id bigint, text string")
    found = {r["doc_id"]: [m["item_id"] for m in r["_matches"]] for r in decontaminate.find(frame(spark, docs), bench).collect()}
    assert [i for i in range(200) if i * 20 not in found[i]] == []


def odd_ids():
    """Texts under null and repeated ids: two copies, a near copy, and different ones."""
    rnd = random.Random(11)
    text = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d = text(60), text(30), text(70), text(90)
    return [(None, a, "a"), (None, b, "a"), (None, a, "a"), (5, c, "a"), (5, d, "a"), (5, c, "a"), (7, d + " more", "a"), (9, text(12), "a")]


def test_substrings_of_odd_ids(spark):
    rows = odd_ids()
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in suffix_dedup.dedup(frame(spark, rows)).collect()]
    a, b, c, d, last = rows[0][1], rows[1][1], rows[3][1], rows[4][1], rows[7][1]
    want = [(i, len(t), 0, t.encode()) for i, t in ((None, a), (None, b), (5, c), (5, d), (9, last))]
    want += [(None, len(a), len(a), b""), (5, len(c), len(c), b""), (7, len(d) + 5, len(d), b" more")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_components_of_odd_ids(spark):
    rows = odd_ids()
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.join_documents(frame(spark, rows), size=5, pct=80).collect()]
    want = [(None, 56, None), (None, 26, None), (None, 56, None), (5, 66, 5), (5, 86, 5), (5, 66, 5), (7, 87, 5), (9, 8, 9)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_pipeline_keeps_texts_of_odd_ids(spark):
    rows = [*odd_ids(), (11, "", "a"), (11, "", "a"), (12, "", "a")]
    out = corpus_pipeline.one_of_each(spark, frame(spark, rows), "")
    want = [(None, rows[0][1]), (None, rows[1][1]), (5, rows[3][1]), (5, rows[4][1]), (9, rows[7][1]), (11, ""), (12, "")]
    assert sorted([(r["doc_id"], r["text"]) for r in out.collect()], key=str) == sorted(want, key=str)
    plain = [(i, t, s) for i, (_, t, s) in enumerate(rows)]
    got = sorted(r["doc_id"] for r in corpus_pipeline.one_of_each(spark, frame(spark, plain), "").collect())
    assert got == [0, 1, 3, 4, 7, 8, 9, 10]
