"""Every operator against a plain model, and on nulls, empty tables, repeats and extra columns."""

import random
import re

import pytest

from corvane.llm import defects, history, leaks, markup, mixing, overlap, spans, wrappers

WORD = re.compile("[a-z0-9]+")


def words(t):
    return WORD.findall((t or "").lower())


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row[-1]


# 3 ---------------------------------------------------------------------------------------------
def _questions(seed, n=60):
    rng, out = random.Random(0), []
    base = [[rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(rng.choice([3, 9, 10, 12, 20, 31, 44]))] for _ in range(12)]
    rng.seed(seed)
    for i in range(n):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(w))
            rng.choice([lambda: w.insert(at, "new"), lambda: w.__setitem__(at, "other"), lambda: w.pop(at) if len(w) > 1 else None])()
        out.append((f"{seed}-{i}", " ".join(w).upper() + "?"))
    return out


def test_overlaps_equal_brute_force(spark):
    a, b = _questions(1), _questions(2)
    want = {(min(x, y), max(x, y)) for x, s in a for y, t in b if edits(words(s), words(t)) <= 0.1 * max(len(words(s)), len(words(t)))}
    train = spark.createDataFrame([*a, a[0], ("n", None), (None, "x y"), ("e", "?!")], "id string, instruction string").withColumnRenamed("x", "x")
    held = spark.createDataFrame([(i, t, "test", None) for i, t in b] + [("z", None, "test", "s")], "id string, instruction string, split string, source string")
    found = overlap.overlaps(train.selectExpr("*", "1 as h", "2 as key", "3 as text"), held)
    assert {tuple(r) for r in overlap.pairs(found).collect()} == want and want
    counts = overlap.counts(found, held).collect()
    assert sum(r["matches"] for r in counts) == len(want) and sum(r["held_rows"] for r in counts) == len(b) + 1


def test_overlaps_of_empty_tables(spark):
    train = spark.createDataFrame([], "id string, instruction string")
    held = spark.createDataFrame([], "id string, instruction string, split string, source string")
    assert overlap.overlaps(train, held).count() == 0


def test_pieces_meet_probes_for_every_near_pair():
    rng = random.Random(5)
    for _ in range(300):
        a = [str(rng.randrange(9)) for _ in range(rng.randrange(9, 48))]
        b = list(a)
        for _ in range(rng.randrange(0, len(a) // 10 + 1)):
            at = rng.randrange(len(b))
            rng.choice([lambda: b.insert(at, "n"), lambda: b.__setitem__(at, "o"), lambda: b.pop(at)])()
        if a != b and edits(a, b) <= max(len(a), len(b)) // 10:
            assert overlap.piece_hashes(a) & overlap.probe_hashes(b) and overlap.piece_hashes(b) & overlap.probe_hashes(a)


# 8 ---------------------------------------------------------------------------------------------
def test_leaks_find_runs_through_markup(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [
        (1, "x one two <b>three</b> four [five](http://a/b) six&nbsp;seven **eight** nine ten ''eleven'' twelve y"),
        (2, "one two three four five six seven eight nine ten eleven. other twelve"),
        (3, "says SHORT\nitem here"), (4, "short thing item here"), (5, None), (6, ""), (None, item), (7, (item + " ") * 3),
    ]
    got = leaks.leaks(spark.createDataFrame([*docs, docs[0]], "doc_id long, text string").selectExpr("*", "1 as item_id"), spark.createDataFrame([(1, item), (2, "short item here"), (3, None), (4, "?")], "item_id long, text string"))
    assert {(r["doc_id"], r["item_id"], r["words"]) for r in got.collect()} == {(1, 1, 12), (3, 2, 3), (7, 1, 13)}
    assert leaks.leaks(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")).count() == 0


# 10 --------------------------------------------------------------------------------------------
def _texts(seed=3):
    rng = random.Random(seed)
    make = lambda n: "".join(rng.choice("abcdefg hijé") for _ in range(n))
    shared = [make(n) for n in (199, 200, 201, 350, 900)]
    docs = [make(rng.randrange(0, 400)) + rng.choice(shared) + make(rng.randrange(0, 400)) for _ in range(30)]
    return [*enumerate([*docs, docs[0], "a" * 700, "ab" + "a" * 300, "", None]), (99, None)]


def test_spans_equal_brute_force(spark):
    rows = _texts()
    text = {i: t for i, t in rows if t}
    grams = {i: {t[p : p + 200] for p in range(len(t) - 199)} for i, t in text.items()}
    want = {(i, j) for i in text for j in text if i < j and grams[i] & grams[j]}
    docs = spark.createDataFrame([*rows, rows[3], (None, "x" * 300)], "doc_id long, text string").selectExpr("*", "1 as h", "2 as a", "3 as rep")
    assert {tuple(r) for r in spans.pairs(*spans.shared_spans(docs)).collect()} == want
    many = {i: sum(any(t[p : p + 200] in grams[j] for j in text if j != i for p in range(max(0, q - 199), q + 1) if p + 200 <= len(t)) for q in range(len(t))) for i, t in text.items()}
    assert {r["doc_id"]: r["shared_chars"] for r in spans.portions(docs).collect()} == {i: n for i, n in many.items() if n}


def test_spans_of_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert spans.pairs(*spans.shared_spans(none)).count() == 0 and spans.portions(none).count() == 0


# 6 ---------------------------------------------------------------------------------------------
def test_repeats_equal_brute_force(spark, tmp_path):
    rng = random.Random(9)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 12, 40]))] for _ in range(15)]
    rows = []
    for i in range(90):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(300)}"
        rows.append((f"c{i:02d}", " ".join(w).title() + ".", rng.randrange(4)))
    sets = {i: frozenset(zip(words(t), words(t)[1:], words(t)[2:])) for i, t, _ in rows}
    near = lambda a, b: words(a[1]) == words(b[1]) or (sets[a[0]] and sets[b[0]] and 10 * len(sets[a[0]] & sets[b[0]]) >= 7 * len(sets[a[0]] | sets[b[0]]))
    want = {(a[0], b[0]) for a in rows for b in rows if a[2] > b[2] and near(a, b)}
    table = spark.createDataFrame([*rows, rows[0], ("n", None, 1), ("e", "??", 2), (None, "a b", 1), ("x", "a b c", None)], "id string, text string, batch_no int").selectExpr("*", "1 as words", "2 as q")
    assert {(r["id"], r["earlier"]) for r in history.repeats(table, str(tmp_path / "h")).collect()} == want and want
    none = spark.createDataFrame([], "id string, text string, batch_no int")
    assert history.repeats(none, str(tmp_path / "none")).count() == 0


# 1 ---------------------------------------------------------------------------------------------
def test_wrapper_takes_out_what_pages_of_a_host_share(spark):
    rng, rows, want = random.Random(4), [], set()
    name = lambda: "".join(rng.choice(["ba", "co", "di", "fu", "ge", "lo"]) for _ in range(9))
    for i in range(60):
        top, title = ["Home / Docs / Search / " + name(), "Share: Mail (" + str(i) + ")"], f"Handling {name()}"
        body = ["Symptom"] + [" ".join(name() for _ in range(25)) + "." for _ in range(3)]
        lines = [top[0], "", title, top[1], "", *body[:2], "", "Symptom", *body[2:], "", "Back to top", f"Contact: {name()}"]
        rows.append((i, f"https://Host.example:8080/{i}", title, "\n".join(lines), "en"))
        want |= {(i, k + 1) for k in (0, 3, len(lines) - 2, len(lines) - 1)}
    more = [(100, "file:///x", "t", "Back to top", "en"), (101, None, None, "Back to top", None), (102, "https://host.example/n", None, None, None), (103, "https://host.example/e", "x", "", "en")]
    docs = spark.createDataFrame([*rows, *more, rows[0]], "doc_id long, url string, title string, text string, lang string").selectExpr("*", "1 as host", "2 as label")
    assert {tuple(r) for r in wrappers.boilerplate(docs).collect()} == want
    clean = dict(map(tuple, wrappers.main_text(docs).collect()))
    assert "Back to top" not in clean[5] and clean[5].startswith("Handling") and 100 not in clean
    assert wrappers.boilerplate(docs.limit(0)).count() == 0


def test_wrapper_is_fitted_on_every_page_of_a_large_host(spark):
    # the notice stands on pages only that a draw of 600 a host by a hash of doc_id would leave out
    out = {r["id"] for r in spark.range(700).where("pmod(xxhash64(id), 700) >= 600").collect()}
    rng, rows = random.Random(6), []
    name = lambda: "".join(rng.choice(["ba", "co", "di", "fu", "ge", "lo"]) for _ in range(9))
    for i in range(700):
        lines = ["", " ".join(name() for _ in range(25)) + ".", "", "Back to top", *["Kept for readers of older releases"] * (i in out)]
        rows.append((i, f"https://host.example/{i}", f"Title {name()}", "en", lines))
    docs = spark.createDataFrame([(i, u, t, "\n".join([t, *x]), g) for i, u, t, g, x in rows], "doc_id long, url string, title string, text string, lang string")
    want = {(i, 5) for i in range(700)} | {(i, 6) for i in out}
    assert {tuple(r) for r in wrappers.boilerplate(docs).collect()} == want and len(out) > 50


@pytest.mark.parametrize("slot", [20_000, 13])
def test_wrapper_votes_equal_those_of_whole_hosts(spark, monkeypatch, slot):
    rng, rows = random.Random(8), []
    for i in range(90):
        blocks = [[4 * n + z for n in range(2) for _ in range(rng.randrange(3))] for z in range(4)]
        at = [b for z in blocks for b in sorted({b: None for b in z}) for _ in range(z.count(b))]
        at = [b for b in at if b < 4 or b - 4 in at]
        rows.append((i, rng.choice("ab"), rng.choice(["en", "fr", None]), i % 9 != 0, list(range(1, len(at) + 1)), [rng.randrange(6) for _ in at], at))
    pages = spark.createDataFrame([*rows, rows[5]], f"doc_id long, {wrappers.LINES}")
    monkeypatch.setattr(wrappers, "SLOT", slot)
    want = {}
    ranked = wrappers._ranked(pages.where("titled").select("host", "lang", "doc_id", "label", "block")).collect()
    assert sorted(r["rank"] for r in ranked if r["host"] == "a") == list(range(len({r[0] for r in rows if r[1] == "a" and r[3]})))
    if slot > 90:
        assert [r["doc_id"] for r in sorted(ranked, key=lambda r: (r["host"], r["rank"]))] == [r[0] for r in sorted((r for r in rows if r[3]), key=lambda r: (r[1], r[2] or "~", r[0]))]
    for h in "ab":
        trees = [wrappers._tree(r["label"], r["block"]) for r in sorted(ranked, key=lambda r: r["rank"]) if r["host"] == h]
        want |= {(h, *k): n for k, n in wrappers.votes(trees, [True] * len(trees)).items() if k[0]}
    for batch in (1, 2, 7, 600):
        monkeypatch.setattr(wrappers, "BATCH", batch)
        got = {(r["host"], r["label"], z): r[x] for r in wrappers.induce(pages).collect() for z, x in enumerate(wrappers.ZONES) if r[x]}
        assert got == want and want


def test_tree_survives_its_row():
    rows = ["Home", "", "Menu one", "Menu two", "", "T", "By x", "", "p" * 200, "a", "", "b", "", "Back", "", "Foot", "Foot two"]
    labels = [len(x) for x in rows]
    zones = wrappers.tree(rows, 5, labels)
    block = {i: 4 * n + z for z, blocks in enumerate(zones) for n, x in enumerate(blocks) for _, i in x}
    again = wrappers._tree(labels, [block.get(i, -1) for i in range(len(rows))])
    assert again == zones and all(zones)


# 4 ---------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "text, kinds, clean",
    [
        ("<h2>Title</h2><ul><li>a</li><li>b &amp; c</li></ul>", {"html"}, "## Title\n\n- a\n- b & c"),
        ("# Title\n\nSome **bold** [link](http://x/y).\n\n```sh\n# not a heading\n```", {"markdown"}, "# Title\n\nSome bold link.\n\n```\n# not a heading\n```"),
        ("h1. Title\n\n# one\n# two\n\n||a||b||\n|1|2|", {"wiki"}, "# Title\n\n1. one\n2. two\n\na | b\n1 | 2"),
        ("== Head ==\n'''bold''' [[Page|text]] {{Cite|x}}done", {"wiki"}, "## Head\n\nbold text done"),
        ("\\section{Head}\n\\begin{itemize}\n\\item one\n\\end{itemize}\n$$x^2$$", {"latex"}, "# Head\n\n- one\n\n$$x^2$$"),
        ("plain <pod-name> a < b and b\n> 9, C:\\new\\table ${HOME} {x} [12] 3\n* 2 snake_case_name", set(), None),
        ("    indented code\n1. one\n- dash", set(), None),
        ("", set(), ""),
    ],
)
def test_markup(text, kinds, clean):
    got, met = markup.convert(text)
    assert met == kinds
    assert got.replace("\n\n\n", "\n\n") == (text if clean is None else clean)


def test_clean_drops_containers_that_lose_their_vote(spark):
    page = lambda i: f'<div class="nav{i}"><a href="/a">Alpha</a><a href="/b">Beta</a></div><div class="main"><p>Body text number {i} of this page, long enough.</p></div>'
    rows = [(i, f"https://h.example/{i}", page(i)) for i in range(5)] + [(9, None, None), (None, "https://h.example/x", "x"), (10, "https://h.example/y", "plain")]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, url string, text string").selectExpr("*", "1 as site", "2 as lost")
    out = {r["doc_id"]: r for r in markup.clean(docs).collect()}
    assert "Alpha" not in out[3]["text"] and "Body text number 3" in out[3]["text"] and out[9]["text"] is None and out[10]["markup"] == []
    assert markup.found(docs.limit(0)).count() == 0


# 5 ---------------------------------------------------------------------------------------------
def test_defects(spark):
    rng = random.Random(2)
    name = lambda: "".join(rng.choice(["ba", "co", "di", "fu", "ge", "lo"]) for _ in range(4))
    en = lambda: f"When the {rng.choice(['disk', 'cache', 'mirror'])} is full, the scheduler of {name()} restarts the workers, because the default limit is low"
    de = lambda: f"Wenn die {rng.choice(['Platte', 'Leitung', 'Freigabe'])} voll ist, startet der Dienst von {name()} die Arbeiter neu, weil die Vorgabe niedrig ist"
    rows = [(f"s{i}", f"What should the operator do with {name()} in that case?", f"{en()}. {en()}.", "g") for i in range(150)]
    rows += [(f"d{i}", f"Was ist zu tun, wenn {name()} nicht mehr antwortet und die Platte voll ist?", f"{de()}. {de()}.", None) for i in range(150)]
    bad = [("b1", "What is it?", None, "empty"), ("b2", "What is it?", " N/A. ", "empty"), ("b3", "What is that?", "Q: What is that?", "copied_question"), ("b4", "What is that?", "WHAT IS THAT", "copied_question"),
           ("b5", "What is that?", "I'm sorry, but I can't help with that.", "refusal"), ("b6", "What should the operator do in that case?", de() + ". " + de() + ".", "wrong_language"), ("b7", "What should I do?", en() + ". When the disk is full, the sched", "truncated"),
           ("b8", "What should I do?", en() + ":\n\n```\nhelm roll", "truncated"), ("b9", None, "", "empty")]
    good = [("g1", "How many?", "12 MiB"), ("g2", "What should I do?", en()), ("g3", "Translate into German: the disk is full", de() + "."), ("g4", "What is that?", f"What is that? {en()}.")]
    table = spark.createDataFrame([*rows, *[(i, q, o, "g") for i, q, o, _ in bad], *[(i, q, o, "g") for i, q, o in good], rows[0], (None, "a", None, "g")], "id string, instruction string, output string, generator string").selectExpr("*", "1 as rank", "2 as key")
    assert dict(map(tuple, defects.defects(table).collect())) == {i: d for i, _, _, d in bad}
    assert defects.defects(table.limit(0)).count() == 0


# 9 ---------------------------------------------------------------------------------------------
def test_permutation_and_shards_are_whole():
    import numpy as np

    for n in (1, 2, 3, 17, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, "k")) == list(range(n))
    slots = [300, 5, 0, 700]
    counts = [mixing.shard_counts(slots, s, 4, 256, 1) for s in range(4)]
    assert [int(c[0].sum()) for c in counts] == [256, 256, 256, 237] and sum(c[0] for c in counts).tolist() == slots
    assert all((counts[i][1] + counts[i][0] == counts[i + 1][1]).all() for i in range(3))


def test_mix_reaches_shares_within_repeats(spark):
    rng = random.Random(1)
    make = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    docs = [(make(900), s) for s, n in (("Big", 60), (" big ", 20), ("small", 10), ("none", 5)) for _ in range(n)] + [(None, "big"), ("", "small"), (make(10), None)]
    targets = [("big", 0.5, 2), ("small", 0.4, 3), ("absent", 0.1, 2), (None, 0.3, 1)]
    d, t = spark.createDataFrame(docs, "text string, source string").selectExpr("*", "1 as block"), spark.createDataFrame([*targets, targets[0]], "source string, weight double, max_repeats int")
    mixed, report = mixing.mix(d, t)
    got = {r["source"]: r for r in report.collect()}
    assert set(got) == {"big", "small", "absent"} and got["absent"]["tokens"] == 0 and got["small"]["uses"] == 3
    assert abs(got["small"]["actual"] - 4 / 9) < 0.03 and abs(got["big"]["actual"] - 5 / 9) < 0.03
    rows = mixed.select("shard", "slot", "source", "block", "use").collect()
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows) == len({(r["source"], r["block"], r["use"]) for r in rows})
    assert max(r["use"] for r in rows) < 3
    more = {r["source"]: r for r in mixing.mix(d, t, total=10.0**6)[1].collect()}
    assert more["small"]["capped"] and more["big"]["capped"] and more["big"]["uses"] == 2
    assert mixing.mix(d.limit(0), t)[0].count() == 0 and mixing.mix(d, t.limit(0))[0].count() == 0


def test_blocks_hold_all_tokens(spark):
    docs = spark.createDataFrame([("hello world " * 300, "a"), ("bye", "a"), ("x", "b")], "text string, source string")
    enc = mixing.encoding(mixing.VOCABULARY)
    want = sum(len(enc.encode_ordinary(t)) + 1 for t in ("hello world " * 300, "bye", "x"))
    rows = mixing.pack(docs, block=64).collect()
    assert sum(r["n_tokens"] for r in rows) == want and all(len(r["tokens"]) == 2 * r["n_tokens"] <= 128 for r in rows)
