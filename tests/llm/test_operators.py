"""Each operator against a plain version, and the cases its docstring defines."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from counterpanel.functions import session
from counterpanel.llm import decontaminate, embedding_dedup, html_text, jaccard, line_dedup, mixing, personal_data, rans
from counterpanel.llm import token_counts, token_output, toxicity
from counterpanel.llm.encode import PieceEncoder

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty and long texts, repeated rows, a hot source, near copies."""
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(vocabulary) for _ in range(90)]
    rows = []
    for i in range(160):
        words = list(base) if i % 3 == 0 else [rnd.choice(vocabulary) for _ in range(rnd.randint(1, 120))]
        for _ in range(rnd.randint(0, 5)):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 9999)}"
        text = " ".join(words[:60]) + "\n" + " ".join(words[60:])
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 7}", len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", None, 0), (202, "One two", "en", "s1", 7), (203, "one TWO", "en", "s1", 7)]
    rows += [(204, "long " * 60000, "en", "hot", 300000), (205, " \t\n", "en", "hot", 3), rows[4], (None, "no id here at all", "en", "s1", 17)]
    return spark.createDataFrame(rows, SCHEMA)


def listed(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def clashing(docs):
    """Extra columns whose names the operators use themselves."""
    return docs.withColumns({c: F.lit(1) for c in ("size", "src", "bucket", "node", "fp", "n", "gram", "h1", "keys", "row", "id", "body")})


def test_mixing_meets_targets(docs):
    a = mixing.taken_words(mixing.mix(clashing(docs))).collect()
    b = mixing.taken_words(mixing.mix(docs)).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))
    sizes = {}
    for r in docs.collect():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(WORD.findall(r["text"] or ""))
    weights = dict(zip(sorted(sizes, key=lambda s: (s is None, s or "")), (5, 2, 1) * 9, strict=False))
    target, open_, left = {}, set(sizes), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weights[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weights[s] > 2 * sizes[s]}
        if not over:
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    target |= {s: level * weights[s] for s in open_}
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in b)
    mixed = mixing.mix(docs).collect()
    for s in sizes:
        taken = sum(r["words"] for r in mixed if r["source"] == s)
        assert abs(taken - target[s]) <= 1 and all(abs(r["target"] - target[s]) < 1e-6 for r in mixed if r["source"] == s)


def test_mixing_quotas_and_documents(spark, docs):
    rows = [r for r in mixing.mix(docs, block_words=16).collect() if r["words"]]
    assert all(r["shard"] is not None for r in rows)
    shard_of = {}
    for r in rows:  # disjoint: a slot of a source is in one shard
        assert shard_of.setdefault((r["source"], r["slot"]), r["shard"]) == r["shard"]
    targets = spark.createDataFrame([("a", 0, 100, 60), ("b", 1, 4, 0), ("c", 2, 0, 9)], "src string, rank int, quota long, spare long")
    quotas = mixing.shard_quotas(targets, 3, 1).collect()
    for src, n, spare in (("a", 100, 60), ("b", 4, 0), ("c", 0, 9)):
        of = sorted((q for q in quotas if q["src"] == src), key=lambda q: q["shard"])
        assert sum(q["quota"] for q in of) == n and all(q["quota"] >= 0 for q in of)
        for a, b in zip(of, of[1:], strict=False):  # ranges do not overlap, draws are counted on
            assert a["start"] + a["quota"] <= b["start"] and a["first"] + a["quota"] == b["first"]
        assert of[-1]["start"] + of[-1]["quota"] <= n + spare
    per_shard = [sum(q["quota"] for q in quotas if q["shard"] == k) for k in range(8)]
    assert max(per_shard) - min(per_shard) <= 1
    texts = mixing.mixed_documents(docs)
    assert texts.columns == docs.columns
    assert sum(len(WORD.findall(r["text"])) for r in texts.collect()) == sum(r["words"] for r in mixing.mix(docs).collect())


def test_mixing_follows_its_tree(spark, docs):
    """Another tree takes other documents, and every target is still met to the word."""
    taken = {}
    for depth, words in ((0, 16), (3, 16), (3, 40)):
        rows = mixing.mix(docs, block_words=words, shard_depth=depth).collect()
        target = {r["source"]: int(r["target"]) for r in rows}
        assert {s: sum(r["words"] for r in rows if r["source"] == s) for s in target} == target
        spans = {}
        for r in rows:  # a word of a copy is taken once
            if r["words"]:
                spans.setdefault((r["row"], r["copy"]), []).append((r["begin"], r["begin"] + r["words"]))
                assert 0 <= r["shard"] < 1 << depth and r["begin"] + r["words"] <= r["size"]
        for s in spans.values():
            s.sort()
            assert all(a[1] <= b[0] for a, b in zip(s, s[1:], strict=False))
        taken[depth, words] = sorted((r["row"], r["copy"], r["begin"], r["words"]) for r in rows if r["words"])
    assert len({str(t) for t in taken.values()}) == 3


def test_mix_is_written_by_shard(spark, docs, tmp_path):
    """Shards hold the mixed rows, cut at words of the document, in order of their keys."""
    mixing.write_mix(docs, str(tmp_path / "mix"), block_words=16, shard_depth=2)
    read = spark.read.parquet(str(tmp_path / "mix"))
    plain = mixing.mixed_documents(docs, block_words=16, shard_depth=2)
    rows = read.collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in rows) == sorted((str(r["doc_id"]), r["text"]) for r in plain.collect())
    assert {r["shard"] for r in rows} == {0, 1, 2, 3}
    whole = {}
    for r in docs.collect():
        whole.setdefault(r["doc_id"], []).append(r["text"] or "")
    assert all(any(r["text"].strip() in t for t in whole[r["doc_id"]]) for r in rows)
    for name in read.inputFiles():
        keys = [r["order_key"] for r in spark.read.parquet(name).collect()]
        assert keys == sorted(keys)


def plain_components(rows):
    sets = []
    for _, text in rows:
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted((str(doc), len(s), str(least.get(find(i)))) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True)))


def test_jaccard_components(docs):
    got = jaccard.jaccard_components(clashing(docs)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain_components(listed(docs))
    kept = jaccard.representatives(docs).collect()
    assert len(kept) == len({(c, d if n == 0 else None) for d, n, c in plain_components(listed(docs))})


@pytest.mark.parametrize("long", [64, 8])
def test_jaccard_verifies_few_pairs_of_a_large_group(spark, monkeypatch, long):
    rng = random.Random(5)
    rows = []
    for group in range(3):  # near copies that chain: few of the pairs that pass the filters link
        words = [f"w{group}x{i}" for i in range(140)]
        for k in range(100):
            at = rng.sample(range(0, 140, 4), 2)
            rows.append((group * 1000 + k, " ".join(f"new{k}" if i in at else w for i, w in enumerate(words))))
    tried = []
    verified = jaccard._verified

    def counted(pairs, *rest):
        tried.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "_verified", counted)
    monkeypatch.setattr(jaccard, "PIVOT_LISTS", long)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == plain_components(rows)
    assert sum(tried) < 4 * len(rows), tried


@pytest.mark.parametrize("long", [line_dedup.LONG, 2])
def test_line_dedup(docs, monkeypatch, long):
    monkeypatch.setattr(line_dedup, "LONG", long)
    rows, lines = listed(docs), []
    for doc, text in rows:
        for i, line in enumerate((text or "").split("\n")):
            w = WORD.findall(line.lower())
            if w:
                lines.append(((doc is None, doc or 0, i), (doc, i), set(w) if len(w) >= 5 else {tuple(w)}))
    gone = {di for o, di, s in lines if any(p < o and 100 * len(s & t) >= 80 * len(s | t) for p, _, t in lines)}
    assert {tuple(r) for r in line_dedup.repeated_lines(clashing(docs)).collect()} == gone
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "n_lines", "n_removed"] and out.count() == docs.count()


def test_line_dedup_short_and_similar_lines(spark):
    words = [f"w{i}" for i in range(20)]
    texts = [(1, "Buy it now\n\n" + " ".join(words)), (2, "buy  IT now\n\n" + " ".join([*words[:7], "other", *words[8:]])), (3, "now buy it\na a a a a"), (4, "a")]
    gone = line_dedup.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(tuple, gone.collect())) == [(2, 0), (2, 2)]
    named = spark.createDataFrame([(*r, 1, 2) for r in texts], "doc_id long, text string, __doc int, __gone int")
    out = line_dedup.dedup_lines(named)
    assert out.columns == [*named.columns, "n_lines", "n_removed"]
    assert {r["doc_id"]: r["text"] for r in out.collect()}[2] == ""


def test_line_dedup_lists_are_split_by_size(spark, monkeypatch):
    """A word of lines of many sizes makes no long list, and no pair at a border of sizes is lost."""
    monkeypatch.setattr(line_dedup, "LONG", 4)
    texts = [" ".join(f"v{i}" for i in range(93))] * 10
    texts += [" ".join(["shared", *(f"v{i}" for i in range(n - 1))]) for n in (5, 8, 12, 18, 27, 41, 62, 93)]
    before = set(session.tables_written(spark))
    gone = line_dedup.repeated_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r["doc_id"] for r in gone.collect()} == {*range(1, 10), 17}
    index = [p for p in session.tables_written(spark) if p not in before and "/line-index-" in p]
    assert index and all(spark.read.parquet(p).isEmpty() for p in index)
    rows = []
    for n in range(4, 140):
        words = [f"n{n}x{i}" for i in range(n)]
        least = -(-n * line_dedup.PERCENT // 100)
        rows += [(10 * n, " ".join(words)), (10 * n + 1, " ".join(words[n - least:])), (10 * n + 2, " ".join(words[: least - 1]))]
    sets = [(d, set(t.split()) if len(t.split()) > 4 else {t}) for d, t in rows]
    want = {d for i, (d, s) in enumerate(sets) if any(100 * len(s & t) >= line_dedup.PERCENT * len(s | t) for _, t in sets[:i])}
    got = line_dedup.repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"] for r in got.collect()} == want and len(want) > 130


def test_tokens_round_trip(spark, docs, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    token_output.write_tokens(clashing(docs), f"file://{tmp_path}/t", path, segment_tokens=1000)
    got = token_output.read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    tok = Tokenizer.from_file(path)
    want = {}
    for doc, text in listed(docs):
        want.setdefault(doc, []).append(tok.encode(text or "", add_special_tokens=False).ids + [2])
    start = 0
    for r in got:
        assert r["ids"] in want[r["doc_id"]] and (r["start"], r["n_tokens"]) == (start, len(r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        start += r["n_tokens"]
    ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in got]
    assert ids == sorted(ids) and len(got) == docs.count()


def test_damage_is_found():
    ids = np.arange(5000, dtype=np.uint32) % 300
    raw = rans.pack_segment(np.array([1]), np.array([False]), np.array([5000]), ids)
    assert (np.concatenate(list(rans.Segment(raw).documents())) == ids).all()
    for at in (30, len(raw) - 9):
        with pytest.raises(ValueError):
            list(rans.Segment(raw[:at] + bytes([raw[at] ^ 1]) + raw[at + 1 :]).documents())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_equal_whole_texts(name):
    rnd = random.Random(1)
    texts = ["", " ", "a  b\n c", "x<|endoftext|> y", "don't  's", "<|endof text|>", "<|endoftext|><|startoftext|>", "tail "]
    texts += ["".join(rnd.choice(" \n\t.,'abZ1\x1c\xa0é̀<|>ß　") for _ in range(50)) for _ in range(300)]
    encoder = PieceEncoder(public_tokenizers.path(name))
    want = [e.ids for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)]
    ids, lengths = encoder.ids_of(pa.array(texts))
    assert lengths.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(docs, name):
    path = public_tokenizers.path(name)
    got = token_counts.count_tokens(clashing(docs), path).collect()
    if name.endswith(".json"):
        tok = Tokenizer.from_file(path)
        count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(model.encode(t))
    want = [(d, len((t or "").encode()), count(t or ""), count(t or "") > 2048) for d, t in listed(docs)]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_toxicity(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choice(["tion", "er", "an", "the", "ou"]) for _ in range(rnd.randint(1, 3))) for _ in range(400)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 4 == 0
        text = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        for _ in range(3 * toxic):
            text[rnd.randrange(len(text))] = rnd.choice(["grumbol", "zaxxid", "vurpnik"])
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    data = spark.createDataFrame([*rows, (5000, None), (5001, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = toxicity.score(data, toxicity.fit(data, known)).withColumn("held", toxicity.held_out()).collect()
    truth = dict(labels)
    held = [r for r in got if r["held"] and r["doc_id"] in truth]
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) > 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got) and len(got) == 1202
    nothing = toxicity.score(data, toxicity.fit(data, known.filter("toxic = 0"))).collect()
    assert all(r["predicted"] == 0 for r in nothing)


def test_decontamination(spark, docs):
    rnd = random.Random(3)
    item = " ".join(rnd.choice(["alpha", "bravo", "delta", "gamma", "omega"]) + str(rnd.randint(0, 99)) for _ in range(30))
    edited = item.replace("alpha", "alpho", 5).upper().replace(" ", ", ", 7)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "?!"), (4, "two three four five six")], "item_id long, text string")
    more = [(301, f"start {item} end"), (302, f"start {edited} end"), (303, item[: len(item) // 2])]
    data = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_items(data, bench).collect()}
    assert got == {(301, 1): 0, (302, 1): min(5, item.count("alpha"))}
    assert got == {(r["doc_id"], r["item_id"]): r["distance"] for r in decontaminate.find_items(data, bench, block_chars=1).collect()}
    assert decontaminate.clean_documents(data, bench).count() == data.count() - 2
    assert decontaminate.find_items(data, bench.filter("item_id > 9")).count() == 0


def test_decontamination_with_repeated_null_and_int_ids(spark):
    long, short = "one item of the benchmark that is rather long for a test", "another shorter item of it"
    bench = spark.createDataFrame([(7, long, 1), (7, short, 1), (None, short, 1)], "item_id int, text string, body int")
    data = spark.createDataFrame([(1, f"x {long} y", 0), (2, f"x {short} y", 0), (2, f"x {short} y", 0), (None, long, 0)], "doc_id int, text string, body int")
    got = sorted((r["doc_id"] or 0, r["item_id"] or 0, r["distance"], r["item_chars"]) for r in decontaminate.find_items(data, bench).collect())
    assert got == [(0, 7, 0, len(long)), (1, 7, 0, len(long)), *[(2, i, 0, len(short)) for i in (0, 0, 7, 7)]]


def test_distance_equals_dynamic_programming():
    rnd = random.Random(1)
    for _ in range(200):
        item, text = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(1, n))) for n in (20, 60))
        row = [0] * (len(text) + 1)
        for ch in item:
            new = [row[0] + 1]
            for j, other in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (ch != other)))
            row = new
        assert decontaminate.occurrence(item, text, 99)[0] == min(row)


def test_base_patterns():
    rnd = random.Random(2)
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    for _ in range(20000):
        t = "".join(rnd.choice("a.@-+% 01259()é") for _ in range(rnd.randint(0, 40)))
        want = [("email", m.start(), m.end()) for m in email.finditer(t)]
        want += [("ip", m.start(), m.end()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m[0].split("."))]
        want += [("card", m.start(), m.end()) for m in card.finditer(t) if 13 <= len(digits(m)) <= 19 and personal_data.luhn(digits(m))]
        want += [("phone", m.start(), m.end()) for m in phone.finditer(t) if 9 <= len(digits(m)) <= 15]
        assert personal_data.base_spans(t) == want


def test_contexts_find_unseen_identifiers(spark, docs):
    rows = [(i, f"word{i} reach account: user{i}@mail.org today") for i in range(400, 420)]
    rows += [(430, "then account: ZX81-99-77 was used"), (431, "plain ZX99-12-34 token")]
    data = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r["doc_id"]: r for r in personal_data.find_personal_data(data).collect()}
    assert got[430]["spans"] == "id:14:24" and got[430]["n_id"] == 1 and got[431]["spans"] == ""
    assert got[400]["n_email"] == 1 and got[400]["spans"].startswith("email:")
    assert got[200]["spans"] == "" and len(got) == len({d for d, _ in listed(data)})


def test_short_and_right_contexts_find_identifiers(spark):
    rows = [(i, f"Contact user{i}@mail.org") for i in range(20)]  # one label word
    rows += [(100 + i, f"case {i % 7}\nuser{i}x@mail.org filed a claim") for i in range(20)]  # right of a line start
    long = "Z9" * 50
    rows += [(200, "form\nContact X1234567"), (201, "X7654321 filed it"), (202, f"the end\nsome X7777777 filed a note\nContact {long}"), (203, "other Q1234567")]
    rows += [(300 + i, f"N{i}00000 alone") for i in range(60)]  # line starts say little here
    got = {r["doc_id"]: r for r in personal_data.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[200]["spans"] == "id:13:21" and got[203]["spans"] == ""
    assert got[201]["spans"] == "" and got[202]["spans"] == f"id:13:21,id:43:{43 + len(long)}"
    assert all(got[300 + i]["n_id"] == 0 for i in range(60))


def test_html(spark):
    page = (
        "<html><head><title>no</title></head><body><nav><a href=x>menu</a></nav><div class='box 12'><h1>Head &amp; line</h1>"
        "<p>First <b>para</b>graph\n with text.<br>more<p>Second one, a > b.<script>var t='</p>'</script></div>"
        "<div class=comments><p>a very long reader comment that goes on and on and on for a while</p></div><footer>foot</footer></body></html>"
    )
    rows = [(1, "http://a.org/1", page), (2, "http://a.org/2", None), (3, None, page), (4, "http://a.org/3", ""), (5, "x", "plain < text")]
    got = {r["page_id"]: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Head & line\nFirst paragraph with text. more\nSecond one, a > b."
    assert got[1]["text"] == got[3]["text"] == want and got[1]["n_chars"] == len(want)
    assert got[2]["text"] == got[4]["text"] == "" and got[5]["text"] == "plain < text"


@pytest.mark.parametrize(
    ("inner", "want"),
    [
        ("<article><h1>Head</h1><p>An intro.</p><div class=body><p>{long}</p></div></article>", "Head\nAn intro.\n{long}"),
        ("<article><h1>Head</h1><p>Intro.</p><section><ul><li>{long}</li><li>{long}</li></ul></section></article>", "Head\nIntro.\n{long}\n{long}"),
        ("<article><div class=lead>A lead.</div><blockquote><p>{long}</p></blockquote></article>", "A lead.\n{long}"),
        ("<div class='page has-sidebar'><h1>Head</h1><div><p>{long}</p></div><div class=sidebar>Side</div></div>", "Head\n{long}"),
        ("<main class=comments-open><p>{long}</p><div class=comments>One comment</div></main>", "{long}"),
        ("<form action=x><input type=hidden name=state><div><h1>Head</h1><p>{long}</p></div></form>", "Head\n{long}"),
        ("<div><p>{long}</p></div><form><p>Your name and all that you want to tell us</p><input name=a><textarea>t</textarea></form>", "{long}"),
        ("<article><p>Also <button>x</button> ends <svg><title>t</title><g>k</g></svg>here.</p><p>{long}</p></article>", "Also ends here.\n{long}"),
        ("<article><p>{long}</p><p>See <select><option>a<option>b</select> it</p></article>", "{long}\nSee it"),
        ("<article><div><p>{long}</p><button>x</div><p>After.</p></article>", "{long}\nAfter."),
        ("<article><p>{long}</p><section id=search-algorithms><p>Search.</p></section><div class=related-posts>No</div></article>", "{long}\nSearch."),
        ("<article><p>{long}</p></article><article class=comment><p>A comment.</p></article>", "{long}"),
        ("<div class=site-footer><p>{long}</p></div><div id=comments><p>{long}</p></div>", ""),
        ("<div class=post><p>{long}</p></div><div class=extra><a href=x>More to read</a></div>", "{long}"),
    ],
)
def test_html_keeps_the_whole_article(spark, inner, want):
    long = "Words of the long part of this article. " * 12
    body = "<html><body class=cookie-consent><nav>menu</nav>" + inner.format(long=long) + "<div class=footer>foot</div></body></html>"
    rows = [(i, f"http://a.org/{i}", body) for i in range(3)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == [want.format(long=long.strip())] * 3


def test_html_long_and_repeated_pages_and_other_columns(spark):
    page = "<html><body><article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(20000)) + "</article></body></html>"
    tie = "<html><body><div><p>One text here</p></div><div><p>Two text here</p></div></body></html>"
    rows = [(1, "http://a.org/1", page, "x", 7)] * 2 + [(2, "http://b.org/", tie, "x", 7), (None, "http://c.org/", "<p>a</p>", "x", 7)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, source string, salt int")).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got)[0] == (0, 1) and len(got) == 4
    assert [r["text"].count("\n") for r in got if r["page_id"] == 1] == [19999] * 2
    assert {r["text"] for r in got if r["page_id"] == 2} <= {"One text here", "One text here\nTwo text here"}


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 16))
    x = np.concatenate([centres[i % 40][None] + rng.normal(scale=0.12, size=(1, 16)) for i in range(400)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, x[0].tolist()) for i in range(30)]
    unit = np.array([v for _, v in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    links = unit @ unit.T >= 0.9
    np.fill_diagonal(links, False)
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, []), (2004, [1.0, None])]
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    found = sum(got[i]["n_links"] for i, _ in rows[:430])
    assert 0.9 * links.sum() <= found <= links.sum() + 2
    assert all(got[2000 + i]["n_links"] == 0 and got[2000 + i]["kept"] for i in range(5))
    assert got[1005]["component_id"] == got[0]["component_id"] and len(got) == len(rows)


@pytest.mark.parametrize("enough", [5, 10**6])
def test_embeddings_are_all_linked_when_the_sample_shows_no_link(spark, monkeypatch, enough):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.normal(size=x.shape)
    away -= (away * x).sum(1, keepdims=True) * x
    away /= np.linalg.norm(away, axis=1, keepdims=True)
    x = np.concatenate([x, 0.91 * x + (1 - 0.91**2) ** 0.5 * away])  # pairs a little above the threshold
    links = x @ x.T >= 0.9
    np.fill_diagonal(links, False)
    monkeypatch.setattr(embedding_dedup, "SAMPLE", 40)
    monkeypatch.setattr(embedding_dedup, "QUERY_VALUES", 16 * 400, raising=False)
    monkeypatch.setattr(embedding_dedup, "LINKED", enough, raising=False)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_duplicates(table).collect()}
    found = sum(got.values())
    assert found <= links.sum() and found >= (links.sum() if enough > 1500 else 0.97 * links.sum())


def test_visits_reach_the_target_or_none_do():
    tally = np.zeros((100, embedding_dedup.MAX_VISITS + 1), np.int64)
    tally[:, 0], tally[:99, 9], tally[99, -1] = 90, 10, 10
    assert embedding_dedup.visits_needed(tally) == 10
    tally[0, 0] = 100_000  # one group holds most links: the other queries still count
    tally[:5, 9], tally[:5, -1] = 0, 200
    assert embedding_dedup.visits_needed(tally) is None


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels, bench = spark.createDataFrame([], "doc_id long, toxic int"), spark.createDataFrame([], "item_id long, text string")
    assert mixing.mix(none).count() == 0 and jaccard.jaccard_components(none).count() == 0
    assert line_dedup.repeated_lines(none).count() == 0 and decontaminate.find_items(none, bench).count() == 0
    assert toxicity.score(none, toxicity.fit(none, labels)).count() == 0
    assert personal_data.find_personal_data(none).count() == 0
    assert token_counts.count_tokens(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_mixing_keeps_repeated_rows_apart(spark):
    """Forty equal rows: as many rows come back, none taken more than twice its size."""
    rows = [(7, "two words", "en", "a", 1)] * 40 + [(8, "x " * 500, "en", "b", 1), (9, None, "en", "b", None)]
    df = spark.createDataFrame(rows, SCHEMA)
    taken = mixing.taken_words(mixing.mix(df)).collect()
    assert len(taken) == 42 and all(0 <= r["taken"] <= 2 * r["size"] for r in taken)
    texts = mixing.mixed_documents(df.withColumn("row", F.lit("mine"))).collect()
    assert {r["row"] for r in texts} == {"mine"}
    assert sum(len(WORD.findall(r["text"])) for r in texts) == sum(r["taken"] for r in taken)
