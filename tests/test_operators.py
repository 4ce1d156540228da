"""Operators of the corpus part: invariants, edge cases, and small cases worked out by hand."""

import json
import re

import pytest
from pyspark.sql import functions as F

from prosemill.functions import text as T
from prosemill.operators import chunking, cleaning, combine, evaluation, features, linking, ranking, splitting, training
from prosemill.operators.detect import detect
from prosemill.sources import builders, readers, sinks
from prosemill.streaming.score import score_stream, submissions

PROSE = "This is a plain sentence of the kind that people write when they explain a thing to each other. "


def labelled(spark, n=240):
    rows = [(i, PROSE * (1 + i % 4) + str(i), i % 3 == 0 and 0 or 1, f"s{i % 2}", f"src{i % 4}", f"g{i // 3}") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, text string, label int, subject string, source string, group_id string")


def test_group_split_has_no_leaks(spark):
    rows = labelled(spark)
    assigned = splitting.group_split(rows)
    assert assigned.count() == rows.count() and not splitting.leaks(assigned, "group_id").count() and not splitting.leaks(assigned, "row_id").count()
    shares = {r["split"]: r["n"] for r in assigned.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert shares["train"] > shares["test"] > 0 and shares["val"] > 0
    assert splitting.group_split(rows.repartition(7)).exceptAll(assigned).count() == 0
    with pytest.raises(ValueError):
        splitting.stratified_split(rows, 0.5, 0.1, 0.1)


def test_singletons_borrow_the_smallest_subject(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (2, 0, "a"), (3, 0, "b"), (4, 0, "c"), (5, 0, "c"), (6, 0, "c"), (7, 1, "b"), (8, 1, None)], "row_id long, label int, subject string")
    got = {r["row_id"]: r["strat"] for r in splitting.strat_keys(rows).collect()}
    assert got == {1: "0__a", 2: "0__a", 3: "0__a", 4: "0__c", 5: "0__c", 6: "0__c", 7: "1__b", 8: "1__"}


def test_auc_and_rates(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.4), (1, 0.8)], "y_true int, y_prob double")
    assert evaluation.roc_auc(rows).first()[0] == pytest.approx(0.875)
    r = evaluation.classification_report(rows, 0.4).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (1, 1, 0, 2) and r["f1"] == pytest.approx(0.8) and r["fpr"] == 0.5
    assert evaluation.roc_auc(rows.where("y_true = 1")).first()[0] == 0.0
    assert evaluation.classification_report(rows.where("false")).first()["accuracy"] == 0.0


def test_intervals_and_t(spark):
    low, high = spark.range(1).select(*evaluation.wilson(F.lit(3), F.lit(50))).first()
    # the interval's ends are the rates that lie z standard errors from 3 / 50
    for p in (low, high):
        assert abs(p - 0.06) / (p * (1 - p) / 50) ** 0.5 == pytest.approx(1.96, abs=1e-6)
    assert spark.range(1).select(*evaluation.wilson(F.lit(0), F.lit(0))).first()[:] == (0.0, 0.0)
    table = spark.createDataFrame([(1, 0.1, 0.2), (2, 0.2, 0.4), (3, 0.15, 0.2)], "fold int, hybrid double, other double")
    r = evaluation.paired_ttest(table, "hybrid", ["other", "hybrid"]).collect()
    assert r[0]["t"] == pytest.approx(-2.6457513, abs=1e-6) and r[0]["p_two_sided"] == pytest.approx(0.1180, abs=1e-3) and r[1]["p_two_sided"] == 1.0
    scores = spark.createDataFrame([(0, (i % 10) / 10, f"g{i % 20}") for i in range(200)], "y_true int, y_prob double, group_id string")
    ci = evaluation.cluster_interval(scores, draws=400).first()
    assert ci["low"] < 0.5 < ci["high"]


def test_passages(spark):
    essay = " ".join(f"Sentence {i} has exactly six words." for i in range(100))
    got = chunking.chunk_fixed_goal(spark.createDataFrame([(1, essay), (2, ""), (3, None), (4, "w " * 1200)], "id long, text string"), 120, 75).collect()
    one = [r for r in got if r["id"] == 1]
    assert [r["words"] for r in one] == [120] * 5 and " ".join(r["text"] for r in one) == essay
    assert [r["words"] for r in got if r["id"] == 4] == [520, 520, 160]
    split = chunking.split_passages(spark.createDataFrame([(1, essay), (2, "short text.")], "id long, cleaned_text string")).orderBy("id").collect()
    assert len(split[0]["passages"]) == 3 and [p["text"] for p in split[1]["passages"]] == ["short text."]


def test_combine_keeps_the_first(spark):
    human = spark.createDataFrame([(0, "same"), (1, " "), (2, "h")], "row long, text string")
    ai = spark.createDataFrame([(0, "same"), (1, "a"), (2, "a")], "row long, text string")
    out = combine.combine({"bawe": combine.normalised(human, "bawe", 0), "claude": combine.normalised(ai, "claude", 1)}, chunk_human=False)
    assert {(r["text"], r["source"], r["group_id"]) for r in out.collect()} == {("same", "bawe", "bawe:0"), ("h", "bawe", "bawe:2"), ("a", "claude", "claude:1")}
    assert combine.combine({}) is None
    ids = [r["row_id"] for r in combine.numbered(spark.range(100).repartition(5), ["id"]).orderBy("id").collect()]
    assert ids == list(range(100))


def test_link(spark):
    topic = {k: " ".join(f"{w}{k}" for w in ("alpha", "beta", "gamma", "delta", "omega")) for k in range(6)}
    rows = [(k, "p", topic[k], "mgtbench_human", f"h{k}") for k in range(6)] + [(10 + k, "p", topic[k] + " polished", "mgtbench", f"a{k}") for k in range(5)] + [(20, "p", "nothing shared here", "mgtbench", "a9")]
    out = linking.link(spark.createDataFrame(rows, "row_id long, subject string, text string, source string, group_id string"))
    got = {r["row_id"]: r["linked_group_id"] for r in out.collect()}
    assert got == {k: f"h{k}" for k in range(6)} | {10 + k: f"h{k}" for k in range(5)} | {20: "a9"}


def test_features(spark):
    tokens = spark.createDataFrame([([(0, 1, "DET", "det"), (1, 2, "NOUN", "nsubj"), (2, 2, "VERB", "ROOT"), (3, 2, "ADV", "advmod")],)], "t array<struct<i:int,head:int,pos:string,dep:string>>")
    f = tokens.select(*(v.alias(k) for k, v in features.syntactic_features(F.col("t")).items())).first()
    assert f["pos_noun_ratio"] == pytest.approx(1 / 3) and f["avg_dependency_length"] == 1.0 and f["mean_parse_tree_depth"] == 1.0
    rows = spark.createDataFrame([(1, "The cat saw the dog."), (2, ""), (3, None)], "row_id long, text string")
    s = {r["row_id"]: r for r in features.style_features(rows).collect()}
    assert s[1]["ttr"] == pytest.approx(0.8) and s[1]["hapax_legomena_ratio"] == pytest.approx(0.6) and s[1]["avg_word_length"] == pytest.approx(3.0) and s[1]["function_word_ratio"] == pytest.approx(0.4)
    assert s[2]["ttr"] == s[3]["ttr"] == 0.0 and s[1]["pos_noun_ratio"] is None
    vectors = spark.createDataFrame([(1, [1.0, 2.0])], "row_id long, embedding array<float>")
    from pyspark.errors import PySparkException

    with pytest.raises(PySparkException, match="different rows"):
        features.fused(rows.select("row_id", F.lit(1.0).alias("a")), vectors, ["a"]).collect()
    got = {r["row_id"]: r["embedding"] for r in features.joined_embeddings(rows, vectors, 2).collect()}
    assert got == {1: [1.0, 2.0], 2: [0.0, 0.0], 3: [0.0, 0.0]}  # blank texts
    with pytest.raises(PySparkException, match="no vector for row 1"):
        features.joined_embeddings(rows, vectors.where("false"), 2).collect()
    assert features.joined_embeddings(rows, vectors.where("false"), 2, missing="zeros").where("row_id = 1").first()["embedding"] == [0.0, 0.0]


def test_tfidf_model(spark, tmp_path):
    import math

    train = spark.createDataFrame([(1, "red apple"), (2, "red apple red pie"), (3, "blue sky")], "row_id long, text string")
    model = features.TfidfModel.fit(train)
    assert set(model.vocabulary) == {"red", "apple", "red apple"}
    model.save(str(tmp_path / "m"))
    again = features.TfidfModel.load(str(tmp_path / "m")).transform(train.unionByName(spark.createDataFrame([(9, None), (10, "unknown")], train.schema)))
    got = {r["row_id"]: {model.vocabulary[i]: v for i, v in zip(r["tfidf"].indices, r["tfidf"].values, strict=True)} for r in again.collect()}
    idf = math.log(4 / 3) + 1
    raw = {"red": (1 + math.log(2)) * idf, "apple": idf, "red apple": idf}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert got[2] == pytest.approx({k: v / norm for k, v in raw.items()}) and got[1] == pytest.approx(dict.fromkeys(raw, 1 / math.sqrt(3))) and got[3] == got[9] == got[10] == {}


def test_ranks_are_those_of_one_window(spark):
    from pyspark.sql import Window

    rows = spark.range(3000).selectExpr("id as row_id", "id % 3 as g", "md5(cast(id % 700 as string)) as o").repartition(5)
    out = ranking.ranked(rows, ["g"], ranking.md5_bucket(F.col("o")), ["o", "row_id"], "nth", "n")
    want = rows.withColumns({"nth": F.row_number().over(Window.partitionBy("g").orderBy("o", "row_id")), "n": F.count("*").over(Window.partitionBy("g"))})
    assert out.select("row_id", "nth", "n").exceptAll(want.select("row_id", "nth", "n")).count() == 0 and out.count() == 3000
    numbered = combine.file_row_id(spark.range(200_000).selectExpr("id as row_id", "'f' || id % 2 as file"))
    assert numbered.where("id != row_id div 2").count() == 0


def test_most_frequent_terms(spark):
    import random

    rng = random.Random(1)
    terms = [(b, f"{rng.choice('abé')}{k}", rng.randrange(1, 5)) for b in ("x", "y") for k in range(400)]
    table = spark.createDataFrame(terms, "block string, term string, total long")
    for most in (1, 37, 399, 1000):
        want = {(b, t) for block in ("x", "y") for b, t, _ in sorted((r for r in terms if r[0] == block), key=lambda r: (-r[2], r[1].encode()))[:most]}
        assert {(r["block"], r["term"]) for r in linking.most_frequent(table, most).collect()} == want


def test_link_in_many_tiles(spark, monkeypatch):
    """Against plain Python, with tiles so small that each row meets many; the closures hold the module's sizes."""
    import math
    import random
    from collections import Counter

    monkeypatch.setattr(linking, "TILE", 7)
    monkeypatch.setattr(linking, "TERMS", 5)
    rng = random.Random(2)
    text = lambda: " ".join(f"t{int(rng.expovariate(0.08))}" for _ in range(rng.randrange(1, 25)))
    rows = [(k, rng.choice(["p", "q", None]), text(), rng.choice(["mgtbench_human", "mgtbench", "mgtbench", "other"]), f"g{k}") for k in range(160)]
    rows += [(200, "p", rows[0][2], "mgtbench", "g200"), (201, "p", "", "mgtbench", "g201"), (202, "only", "t1 t2", "mgtbench", "g202")]
    got = {r["row_id"]: r["linked_group_id"] for r in linking.link(spark.createDataFrame(rows, "row_id long, subject string, text string, source string, group_id string")).collect()}
    want = {r[0]: r[4] for r in rows}
    for subject in ("p", "q", None, "only"):
        both = [r for r in rows if r[1] == subject and r[3] in ("mgtbench_human", "mgtbench")]
        tf = {r[0]: Counter(r[2].split()) for r in both}
        df = Counter(t for c in tf.values() for t in c)
        vec = {}
        for k, c in tf.items():
            w = {t: (1 + math.log(n)) * (math.log((1 + len(both)) / (1 + df[t])) + 1) for t, n in c.items() if df[t] >= 2}
            norm = math.sqrt(sum(x * x for x in w.values()))
            vec[k] = {t: x / norm for t, x in w.items()}
        for a in (r for r in both if r[3] == "mgtbench"):
            sims = [(-round(sum(x * vec[h[0]].get(t, 0) for t, x in vec[a[0]].items()), 9), h[0]) for h in both if h[3] == "mgtbench_human"]
            if sims and -min(sims)[0] >= 0.3:
                want[a[0]] = f"g{min(sims)[1]}"
    assert got == want


def test_training(spark):
    from pyspark.ml.functions import array_to_vector

    rows = labelled(spark, 120).withColumn("features", array_to_vector(F.array((F.col("label") + (F.col("row_id") % 5) / 10).cast("double"), (F.col("row_id") % 7).cast("double"))))
    grid = [{"maxDepth": 1, "maxIter": 2}, {"maxDepth": 2, "maxIter": 2}]
    search = training.train_booster(rows.where("row_id % 4 > 0"), rows.where("row_id % 4 = 0"), grid)
    assert search.chosen["depth"] == 1 and search.model is not None
    ranked = training.cross_validated(rows, grid, 2)
    chosen = training.select_on_validation(ranked, rows.where("row_id % 4 > 0"), rows.where("row_id % 4 = 0"), 1)
    assert chosen.chosen["cv_rank"] == 0 and len(training.default_grid()) == 32
    assert training.importances(chosen.model, ["a", "b"]).count() == 2


def test_funnel(spark):
    rows = spark.createDataFrame([(1, PROSE), (2, " "), (3, "hola que tal"), (4, "`a` `b` `c` x"), (5, None)], "id long, text string")
    got = {r["id"]: r["drop_reason"] for r in cleaning.clean_rows(rows).collect()}
    assert got == {1: None, 2: "empty", 3: "foreign", 4: "dense", 5: "empty"}
    plan = cleaning.kept(cleaning.clean_rows(rows))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 1


def test_detect_batch_and_stream(spark, tmp_path):
    texts = {"a": PROSE * 40, "b": "too short", "c": " ".join(f"w{i}" for i in range(50)), "d": "`x` " * 60}
    rows = spark.createDataFrame(list(texts.items()), "id string, text string")
    batch = {r["id"]: r for r in detect(rows).collect()}
    assert batch["a"]["status"] == "ok" and 0 <= batch["a"]["ai_probability"] <= 100 and len(batch["a"]["passages"]) > 1
    assert batch["b"]["status"] == "too_few_words" and batch["c"]["status"] == "ok" and batch["d"]["status"] == "too_little_prose"
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "one.json").write_text("\n".join(json.dumps({"id": k, "text": v}) for k, v in texts.items()))
    score_stream(submissions(spark, str(folder)), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    stream = {r["id"]: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert {k: (r["status"], r["ai_probability"], r["band"]) for k, r in stream.items()} == {k: (r["status"], r["ai_probability"], r["band"]) for k, r in batch.items()}


def test_readers_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted"\nline', "x.txt"), (2, "b,c", "y.txt")], "id long, text string, file string")
    sinks.write_csv(rows, str(tmp_path / "csv"))
    assert readers.read_csv(spark, str(tmp_path / "csv"), readers.SCHEMAS["raw_ai"]).exceptAll(rows).count() == 0
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "text": "t"}, {"id": 2, "text": "u"}]))
    assert readers.read_json_arrays(spark, [str(tmp_path / "a.json"), str(tmp_path / "none.json")], "id long, text string").count() == 2
    tree = tmp_path / "tree" / "Physics"
    tree.mkdir(parents=True)
    (tree / "x.txt").write_text("whole\ntext")
    assert readers.read_text_tree(spark, str(tmp_path / "tree")).first()[:] == ("whole\ntext", "x.txt", "Physics")
    xml = '<!DOCTYPE TEI><TEI><sourceDesc><p n="discipline">{}</p></sourceDesc><person><p n="course">BA</p></person><body><p>One\n two <b>three</b></p></body></TEI>'
    for name, content in (("AH/Law/1.xml", xml.format("Law")), ("AH/Law/2.xml", xml.format("other")), ("AH/Law/3.xml", "<broken"), ("AH/Law/4.xml", "<TEI><body> </body></TEI>")):
        (tmp_path / "c" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / name).write_text(content)
    got = {r["id"]: r for r in readers.read_tei(spark, str(tmp_path / "c")).collect()}
    assert set(got) == {"1", "2"} and got["1"]["text"] == "One two three" and got["1"]["subject"] == "Law" and got["2"]["subject"] == "AH_other" and got["1"]["file"] == "AH/Law/1.xml"
    assigned = splitting.group_split(labelled(spark))
    sinks.write_split(assigned, str(tmp_path / "split"))
    assert sinks.read_split(spark, str(tmp_path / "split"), "test").count() == assigned.where("split = 'test'").count()
    with pytest.raises(ValueError):
        readers.require_columns(rows, ["id", "course"])


def test_conversations(spark):
    turns = "[{'from': 'system', 'value': 's'}, {'from': 'human', 'value': 'Hi there '}, {'from': 'gpt', 'value': 'one'}, {'from': 'human', 'value': 'more'}, {'from': 'assistant', 'value': 'two'}]"
    rows = spark.createDataFrame([(turns,), ("  plain text ",), (None,)], "t string")
    got = [(r["p"]["prompt"], r["p"]["response"]) for r in rows.select(readers.conversation_parts(F.col("t")).alias("p")).collect()]
    assert got == [("Hi there", "one two"), ("", "plain text"), ("", "")]


def test_oracles_have_queries():
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 70
    assert all(re.fullmatch(r"\w+", k) for k in queries)


def test_words(spark):
    got = spark.createDataFrame([("a [[CODE]] b c",), (None,)], "t string").select(T.count_words(F.col("t")), T.score_band(F.lit(20.0))).collect()
    assert [r[0] for r in got] == [3, 0] and got[0][1] == "Likely Human-Written"


def test_conversation_literals(spark):
    cases = {
        None: ("", ""), " plain text ": ("", "plain text"), "[1, 2]": ("", "[1, 2]"),
        "[{'from': 'human', 'value': 'why?'}, {'from': 'gpt', 'value': 'as' ' it \\x41'}]": ("why?", "as it A"),
        "[{'from': 'system', 'value': 's'}, {'from': 'human', 'value': ''}, {'from': 'human', 'value': 'q'}, {'from': 'assistant', 'value': 'a'}, {'from': 'gpt', 'value': 'b '}]": ("q", "a b"),
        "[{'from': 'human', 'value': \"it's\"}, {'from': 'gpt', 'value': None}]": ("it's", "[{'from': 'human', 'value': \"it's\"}, {'from': 'gpt', 'value': None}]"),
        "[{'from': 'human', 'value': \"q\"}, {'from': 'gpt', 'value': \"broken\"}": ("q", "broken"),
        "[{'from': 'gpt', 'value': 'never closed": ("", "[{'from': 'gpt', 'value': 'never closed"),
    }
    rows = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: (r["p"]["prompt"], r["p"]["response"]) for r in rows.select("t", readers.conversation_parts(F.col("t")).alias("p")).collect()}
    assert got == cases


def test_builders(spark, tmp_path):
    texts = [PROSE * 6 + "See https://x.org now.", PROSE * 6, "", None, "Это по-русски", "[[CODE]] " * 40, "# Title **bold** words of " + PROSE]
    rows = spark.createDataFrame([(t, 1, None, "s", None) for t in texts], "text string, label int, prompt_name string, source string, RDizzl3_seven string")
    sinks.write_csv(rows.coalesce(1), str(tmp_path / "raw"))
    kept, summary = builders.build(spark, "gemini", str(tmp_path / "raw"), str(tmp_path / "out"))
    counts = {r["Metric"]: r["Count"] for r in summary.collect()}
    assert counts["Total Rows Loaded"] == 7 and counts["Dropped (empty)"] == 2 and counts["Dropped (foreign)"] == 1 and counts["Dropped (dense)"] == 1 and counts["Rows Kept"] == kept.count() == 3 and counts["[[URL]] Tags Inserted"] == 1
    assert kept.columns == list(builders.SOURCES["gemini"].output) and kept.where("text like 'Title bold words%'").count() == 1
    builders.build(spark, "gemini", str(tmp_path / "raw"), str(tmp_path / "out"), sample_size=2)
    assert (tmp_path / "out" / "gemini_cleaned_sample_2").is_dir()
    with pytest.raises(ValueError):
        builders.prepared(rows.drop("label"), "gemini")


def test_ingest_counts_what_it_cannot_read(spark, tmp_path):
    good = '<!DOCTYPE TEI><TEI><sourceDesc><p n="discipline">Law</p></sourceDesc><body><p>Some  words</p><p>more</p></body></TEI>'
    for name, text in (("a.xml", good), ("b.xml", "<TEI>"), ("c.xml", "<TEI><body> </body></TEI>"), ("d.xml", good)):
        (tmp_path / "AH" / "Law").mkdir(parents=True, exist_ok=True)
        (tmp_path / "AH" / "Law" / name).write_text(text)
    summary = {r["Metric"]: r["Count"] for r in builders.ingest_essays(spark, str(tmp_path), str(tmp_path / "out")).collect()}
    assert summary == {"XML files found": 4, "Rows written": 2, "Skipped (unreadable)": 2, "Unique subjects": 1}


def test_embeddings_go_on_where_they_stopped(spark, tmp_path):
    rows = spark.range(40).selectExpr("id as row_id", "'t' || id as text")
    calls = []

    def encoder(text):
        calls.append(1)
        if len(calls) == 3:
            raise RuntimeError("stopped")
        return F.array(F.length(text).cast("float"))

    with pytest.raises(RuntimeError):
        sinks.embed(rows, encoder, str(tmp_path / "e"), 4)
    out = sinks.embed(rows, encoder, str(tmp_path / "e"), 4)
    assert len(calls) == 5 and out.count() == out.select("row_id").distinct().count() == 40
