import random

from conftest_llm import ODD, texts_of

from sparkweave.llm import decontaminate as d

ITEM = "A train leaves the station at 40 km per hour and Maria walks 12 km in the same time, how far is the next town after 3 hours of steady travel"
OTHER = ITEM.replace("40", "55").replace("12", "9").replace("Maria", "Tomas").replace("3 hours", "7 hours")
BROKEN = "We put 5 apples into the basket near the old wooden door and later we took 5 apples out of it again"


def found(spark, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'q' AS doc_id", "1 AS size")
    return {(r["doc_id"], r["item_id"]): r for r in d.contaminated(docs, bench).collect()}


def test_verbatim_and_reparameterised_questions(spark, docs_of):
    rng = random.Random(2)
    filler = lambda: " ".join(f"word{rng.randrange(9999)}" for _ in range(30))
    docs = docs_of([
        (1, f"{filler()}. {ITEM}. {filler()}"), (2, f"{filler()}\n{OTHER} {filler()}"), (3, filler()), (4, "A train leaves the station at 40 km per"),
        (5, BROKEN.replace("took 5", "took 6")), (6, BROKEN.replace("5", "4")), (7, BROKEN), *[(100 + r[0], r[1]) for r in ODD if r[0]],
    ])
    got = found(spark, docs, [(1, ITEM), (2, BROKEN), (3, None), (4, ""), (5, "too few words"), (1, ITEM)])
    # 5: one value of the item stands for two, but 16 and 18 words are the item's own; 3 words are an item, too.
    assert set(got) == {(1, 1), (2, 1), (5, 2), (6, 2), (7, 2)}
    assert got[1, 1]["n_words"] >= 20
    assert found(spark, docs, []) == {} and found(spark, docs.limit(0), [(1, ITEM)]) == {}


def test_join_without_the_broadcast_filter_gives_the_same(spark, docs_of, monkeypatch):
    docs = docs_of([(1, f"so {ITEM}."), (2, "nothing of it " * 20), (3, OTHER)])
    want = set(found(spark, docs, [(1, ITEM)]))
    monkeypatch.setattr(d, "MOST_HASHES", 0)
    monkeypatch.setattr(d, "MOST_BROADCAST", 0)
    assert set(found(spark, docs, [(1, ITEM)])) == want == {(1, 1), (3, 1)}


def test_passages_of_the_test_tables(spark, docs_of):
    """Documents that hold a whole item, and only these, are found."""
    import duckdb

    items = duckdb.execute("SELECT item_id, text FROM '/root/testdata/sf0.01/benchmark.parquet'").fetchall()
    rows = [(i, t) for i, t, _ in texts_of("/root/testdata/sf0.01")]
    flat = lambda t: " ".join((t or "").split())
    want = {(i, item) for i, t in rows for item, text in items if flat(text) in flat(t)}
    assert want and set(found(spark, docs_of(rows), items)) == want


def test_filter_keeps_clean_documents(spark, docs_of):
    docs = docs_of([(1, ITEM), (2, "clean"), (2, "clean"), (None, "no id"), (3, None)])
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    out = d.drop_contaminated(docs, bench)
    assert out.columns == docs.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["2", "2", "3", "None"]


BOAT = "A boat goes 40 km at 8 km per hour and Maria pays 12 dollars for 3 hours on it"
NAMES = "the guests were Anna Berg, Boris Cole, Carla Diaz, David Egan, Elena Fox, Felix Gray, Greta Hall and Hugo Iver"


def test_copies_with_few_plain_words_are_whole(spark, docs_of):
    other = BOAT.replace("40", "55").replace("Maria", "Tomas").replace("12", "17")
    docs = docs_of([(1, f"some words. {BOAT}. more words"), (2, f"some words. {other}. more words"), (3, f"so {NAMES}, he said"), (4, f"so {ITEM}."), (5, "Anna Berg and Carla Diaz pay 12 dollars for 3 hours " * 3)])
    got = found(spark, docs, [(1, BOAT), (2, NAMES), (3, ITEM)])
    assert set(got) == {(1, 1), (2, 1), (3, 2), (4, 3)}
    assert got[1, 1]["n_words"] == got[2, 1]["n_words"] == 20 and got[3, 2]["n_words"] == 20 and got[4, 3]["n_words"] >= 25


def test_one_changed_value_leaves_the_rest_of_a_long_passage(spark, docs_of):
    rng = random.Random(4)
    plain = lambda n: " ".join(f"word{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(n))
    passage = " ".join(f"{plain(18)} Maria has 5" for _ in range(9))
    at = passage.rindex("5", 0, -1)
    docs = docs_of([(1, passage[:at] + "6" + passage[at + 1 :]), (2, passage.replace("Maria", "Mario", 1)), (3, passage), (4, passage.replace("5", "8"))])
    got = found(spark, docs, [(1, passage)])
    assert set(got) == {(k, 1) for k in (1, 2, 3, 4)} and got[1, 1]["n_words"] > 150 and got[2, 1]["n_words"] > 150 and got[3, 1]["n_words"] == 189


def test_consistent_stretches():
    assert d.consistent([[(1, 1)], [(1, 1)], [], [(1, 2)], [(1, 2)]]) == [(0, 3), (2, 5)]
    assert d.consistent([[(1, 1)], [(2, 1)]]) == [(0, 2)] and d.consistent([[(1, 1), (1, 2)], [(3, 3)]]) == [(1, 2)] and d.consistent([]) == []
    assert d.consistent([[(1, 1)], [(1, 2)], [(1, 1)]]) == [(0, 1), (1, 2), (2, 3)]


def test_case_and_punctuation_hide_no_copy(spark, docs_of):
    item = "Anna's boat left at dawn. Boris didn't see it. The harbour of Genoa was cold, and nobody waved. Carla wrote it down. Then Anna came home."
    forms = [item.upper(), item.title().replace("'S", "'s").replace("'T", "'t"), item.lower(), item.replace(".", ""), item.replace("'", "’"), item.replace(",", "").replace(".", ";").upper()]
    docs = docs_of([(k, f"some text before {t} some text after") for k, t in enumerate(forms)])
    got = found(spark, docs, [(1, item), (2, ITEM.upper())])
    assert set(got) == {(k, 1) for k in range(len(forms))} and all(r["n_words"] == len(item.split()) for r in got.values())
    assert set(found(spark, docs_of([(1, ITEM.title()), (2, ITEM)]), [(1, ITEM), (2, ITEM.upper())])) == {(i, k) for i in (1, 2) for k in (1, 2)}


def test_short_items_and_lists_of_names(spark, docs_of):
    names = "John Smith met Anna Jones in Paris on Monday and Peter Brown saw Carl Weber on Friday"
    docs = docs_of([(1, f"before it {names} after it"), (2, "so what is 2 + 2 then"), (3, "what is the answer"), (4, "Anna Jones was in Paris")])
    assert set(found(spark, docs, [(1, names), (2, "what is 2 + 2")])) == {(1, 1), (2, 2)}


def test_items_of_few_words(spark, docs_of):
    docs = docs_of([(1, "He asked: who wrote hamlet, and nobody knew"), (2, "Who wrote the letter? Hamlet"), (3, "Say cheese!"), (4, "cheese, say"), (5, "x 42 y"), (6, "x 43 y"), (7, None)])
    got = found(spark, docs, [(1, "Who wrote Hamlet?"), (2, "say cheese"), (3, "42"), (4, "")])
    assert set(got) == {(1, 1), (3, 2), (5, 3)} and got[1, 1]["n_words"] == 3


def plain_version(docs, items):
    """The same by comparing all windows of all items with all windows of all texts, word by word."""

    def read(text):
        out, start = [], True
        for raw in (text or "").split():
            word = raw.strip(d.STRIP)
            low = word.lower()
            if low and low[0] in "0123456789$€£+-" and d.NUMBER.fullmatch(low) or low in d.NUMBER_WORDS:
                kind = "<number>"
            elif low in d.UNITS:
                kind = "<unit>"
            else:
                kind = "<name>" if word[:1].isupper() and not start else low
            start = raw[-1] in ".!?:\"”»"
            if low:
                out.append((kind, low.translate(d.APOSTROPHES)))
        return out

    slot = lambda w: w[0].startswith("<")
    pattern = lambda ws: [[x[1] for x in ws if slot(x)].index(w[1]) for w in ws if slot(w)]
    out = {}
    for item, text in items:
        b = read(text)
        size = min(len(b), d.WINDOW) or d.WINDOW
        least = min(d.RUN, len(b) - 1)
        for doc, other in docs:
            t = read(other)
            runs, ended = [], {}
            for apart in range(-len(b), len(t) + 1):
                windows = {}
                for i in range(len(b) - size + 1):
                    j = i + apart
                    if j < 0 or j + size > len(t):
                        continue
                    x, y = b[i : i + size], t[j : j + size]
                    plain = [w[1] for w in x] == [w[1] for w in y]
                    alike = size >= d.LEAST_WORDS and [w[0] for w in x] == [w[0] for w in y] and pattern(x) == pattern(y)
                    enough = alike and sum(not slot(w) for w in x) >= min(d.LEAST_LITERAL, size - 1)
                    if plain or alike:
                        pairs = {(v[1], (v if plain and not alike else w)[1]) for v, w in zip(x, y) if slot(v)}
                        windows[i] = (plain or enough, enough, pairs)
                run = []
                for i in range(len(b) + 1):
                    if i in windows:
                        run.append(windows[i])
                    elif run:
                        runs.append(run)
                        run = []
            held, longest = 0, 0
            for run in runs:
                if not any(w[0] for w in run) or len(run) + size - 1 < least:
                    continue
                n = len(run)
                agrees = lambda part: all(len({q for p, q in set().union(*(w[2] for w in part)) if p == a}) == 1 for a, _ in set().union(*(w[2] for w in part)))
                whole = agrees([w for w in run if w[1]])
                good = set()
                for x in range(n):
                    for y in range(x + 1, n + 1):
                        part, words = run[x:y], y - x + size - 1
                        same = all(p == q for w in part for p, q in w[2])
                        if any(w[0] for w in part) and (words >= (least if whole else d.BROKEN_RUN) and agrees(part) or not whole and words >= least and same):
                            good |= set(range(x, y))
                            longest = max(longest, words)
                held += len(good)
            if held:
                out[doc, item] = (held, longest)
    return out


def test_equals_the_plain_version(spark, docs_of):
    rng = random.Random(11)
    words = "the old boat goes to a cold town where people pay and talk about rain near its gate".split()
    pick = lambda n: " ".join(rng.choice([*words, "5", "7", "12", "km", "Maria", "Tomas", "Genoa", "it."]) for _ in range(n))
    items = [(k, pick(rng.choice([1, 2, 3, 4, 5, 6, 8, 12, 20, 30, 45]))) for k in range(40)]
    docs = []
    for k in range(160):
        t = rng.choice(items)[1].split()
        for _ in range(rng.choice([0, 0, 1, 2, 4])):  # changed values and words
            t[rng.randrange(len(t))] = rng.choice(["6", "7", "Carla", "mile", "cold"])
        docs.append((k, f"{pick(rng.randrange(12))} {' '.join(t)} {pick(rng.randrange(12))} {rng.choice(items)[1] if rng.random() < 0.3 else ''}"))
    got = {k: (r["n_windows"], r["n_words"]) for k, r in found(spark, docs_of(docs), items).items()}
    assert got == plain_version(docs, items) and len(got) > 100
