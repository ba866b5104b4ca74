"""Languages of texts in shared scripts, beside plain Python."""

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from colophon.functions import normalise as N
from colophon.functions.text import compatible
from colophon.operators import composition as C

KANA, LATN, JPN, CYRL = r"[ァ-ヺヽ-ヿㇰ-ㇿー゙゚゛゜]+", r"[A-Za-zÀ-ÖØ-öø-ɏ]+(?:['’=-][A-Za-zÀ-ÖØ-öø-ɏ]+)*", r"[぀-ゟ㐀-鿿々]", r"[Ѐ-ӿ]"


def runs(line):
    line = unicodedata.normalize("NFKC", line or "")
    bare = lambda r: unicodedata.normalize("NFC", re.sub("[゙゚゛゜]", "", unicodedata.normalize("NFD", r)))
    kana = [r for r in map(bare, re.findall(KANA, line)) if re.search("[ァ-ヺㇰ-ㇿ]", r)]
    return line, {"kana": kana, "latn": [r.lower() for r in re.findall(LATN, line)]}


def grams(run):
    unit = f" {run} "
    return [unit[i : i + 3] for i in range(len(unit) - 2) if len(unit[i : i + 3].strip()) >= 2]


def judged(run_list, profile):
    langs = sorted(profile)
    known = [g for r in run_list for g in grams(r) if any(g in profile[x] for x in langs)]
    if not known:
        return None, 0, 0
    mean = sorted((-sum(round(math.log10(profile[x][g] / sum(profile[x].values()) + 1e-6) * 1e6) for g in known) / len(known), x) for x in langs)
    return mean[0][1], (mean[1][0] if len(mean) > 1 else math.inf) - mean[0][0], len(known) / sum(len(grams(r)) for r in run_list)


def composition(lines, profiles, lexicon):
    out = defaultdict(Counter)
    for doc, _, text in lines:
        line, parts = runs(text)
        anchored = len(re.findall(JPN, line))
        out[doc]["jpn"] += anchored
        out[doc]["rus"] += len(re.findall(CYRL, line))
        for channel, found in parts.items():
            rest = []
            for r in found:
                lang, margin, coverage = judged([r], profiles[channel])
                listed = {(c, x) for c, x, _ in lexicon}
                if len(r) >= 4 and margin >= 5e5 and coverage >= 0.3 and ((channel, lang) not in listed or (channel, lang, r) in lexicon):
                    out[doc][lang] += len(r)
                else:
                    rest.append(r)
            if rest:
                lang, margin, coverage = judged(rest, profiles[channel])
                sure = lang and margin >= 5e4 and coverage >= 0.3
                out[doc][lang if sure else "jpn" if channel == "kana" and anchored >= 2 else "und"] += sum(map(len, rest))
    return {(d, x): n for d, c in out.items() for x, n in c.items() if n}


def test_composition_beside_plain_python(spark):
    rng = random.Random(5)
    words = {"ain": ["アイヌ", "カムイ", "イタㇰ", "チセ", "kamuy", "aynu", "itak", "cise"], "jpn": ["コンピューター", "ガラス", "パン", "nihon", "kotoba", "バス"], "eng": ["language", "house", "the", "spirit", "Ainu's"]}
    attested = [(x, " ".join(rng.choice(w) for _ in range(12))) for x, w in words.items() for _ in range(15)] + [(None, "zzz"), ("eng", None)]
    other = ["日本", "の", "言", "слово", "ー", "ﾊﾞｽ", "qqqqzz", "1901", "a", "ガラㇰ", "カムイチセ", "language-house"]
    every = [w for x in words.values() for w in x] + other
    lines = [(d, n, " ".join(rng.choice(every) for _ in range(rng.randint(0, 7)))) for d in range(40) for n in range(4)] + [(90, 0, None), (91, 0, ""), (92, 0, "のの パン qq")]
    lexicon = [("latn", "ain", "kamuy"), ("latn", "ain", "itak")]
    profiles = {c: defaultdict(Counter) for c in ("kana", "latn")}
    for lang, text in attested:
        if lang:
            for c, found in runs(text)[1].items():
                for r in found:
                    profiles[c][lang].update(grams(r))
    learned = C.profiles_of(spark.createDataFrame(attested, "lang string, text string"))
    assert {(r["channel"], r["lang"], r["gram"]): r["cnt"] for r in learned.collect()} == {(c, x, g): n for c, p in profiles.items() for x, k in p.items() for g, n in k.items()}
    table = spark.createDataFrame(lines, "doc_id int, line_no int, text string").withColumn("run", F.lit(1))
    got = {(r["doc_id"], r["lang"]): r["chars"] for r in C.language_composition(table, learned, spark.createDataFrame(lexicon, "channel string, lang string, run string")).collect()}
    assert got == composition(lines, profiles, set(lexicon))
    assert {x for _, x in got} >= {"ain", "jpn", "eng", "rus", "und"} and not any(d in (90, 91) for d, _ in got)


def test_without_profiles_only_anchors_decide(spark):
    lines = spark.createDataFrame([(1, 0, "日本 カムイ house"), (2, 0, "")], "doc_id int, line_no int, text string")
    none = spark.createDataFrame([], "channel string, lang string, gram string, cnt long")
    assert {(r["doc_id"], r["lang"], r["chars"]) for r in C.language_composition(lines, none).collect()} == {(1, "jpn", 5), (1, "und", 5)}


def test_runs_of_odd_lines(spark):
    odd = ["İstanbul Ärger-Maß a-b--c 'x' l’eau=x-", "ㇷ゚ カ゛ ヴァイオリン ゙ガ ーー バ\nパー", None, "", "ﾊﾞｽ ｌａｔｉｎ ﬁn", "-", "x" * 50, "éa ́b", "𝐀𝛀 ア", "a\n\nb"]
    got = [(r["n"], r["channel"], r["run"]) for r in C.runs_of_lines(spark.createDataFrame(list(enumerate(odd)), "n int, text string").coalesce(1), ["n"]).collect()]
    assert sorted(got) == sorted((n, c, r) for n, t in enumerate(odd) for c, found in runs(t)[1].items() for r in found)
    # The same as by patterns.
    line = compatible(F.coalesce("text", F.lit("")))
    kana = spark.createDataFrame(list(enumerate(odd)), "n int, text string").select("n", F.explode(N.script_runs(N.unvoiced_kana(line), "kana")).alias("run")).where(r"run rlike '[\\p{IsKatakana}&&[^ー]]'")
    assert sorted(tuple(r) for r in kana.collect()) == sorted((n, r) for n, c, r in got if c == "kana")


def test_runs_are_not_shuffled(spark):
    attested = [("eng", "the house language spirit"), ("jpn", "nihon kotoba カラス")] * 5
    lines = spark.createDataFrame([(d, n, "the house nihon ガラス 言葉 zz " * 20) for d in range(10) for n in range(3)], "doc_id int, line_no int, text string")
    learned = C.profiles_of(spark.createDataFrame(attested, "lang string, text string"))
    found = C.language_composition(lines, learned)
    exchanges = [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hash" in x]
    assert exchanges and all("doc_id" in x for x in exchanges)
    # A language's words, as its own lines have them, decide for it.
    lexicon = C.runs_of_lines(spark.createDataFrame([("eng", "house")], "lang string, text string"), ["lang"])
    assert [tuple(r) for r in lexicon.select("lang", "channel", "run").collect()] == [("eng", "latn", "house")]
    rows = {(d, n): "house language spirit" for d in range(3) for n in range(2)}
    guarded = {(r["doc_id"], r["lang"]): r["chars"] for r in C.language_composition(spark.createDataFrame([(d, n, t) for (d, n), t in rows.items()], "doc_id int, line_no int, text string"), learned, lexicon).collect()}
    profiles = {"latn": defaultdict(Counter), "kana": defaultdict(Counter)}
    for lang, text in attested:
        for c, found in runs(text)[1].items():
            for r in found:
                profiles[c][lang].update(grams(r))
    assert guarded == composition([(d, n, t) for (d, n), t in rows.items()], profiles, {("latn", "eng", "house")})


def test_slices_hold_every_line_once(spark, monkeypatch):
    class Held:
        value = C._classes(spark)

    texts = ["house", None, "", "カムイ kamuy itak", "a b", "language-house"] * 7
    batch = pa.RecordBatch.from_pydict({"text": texts})
    of = lambda parts: [(c, runs_.to_pylist()[k]) for c in C.SHARED for p in parts for _, codes, runs_ in [p.runs(c)] for k in codes]
    whole = of([*C._slices([batch], Held)])
    monkeypatch.setattr(C, "SLICE_CHARACTERS", 12)
    parts = [*C._slices([batch, batch.slice(0, 0)], Held)]
    assert of(parts) == whole and len(parts) > 7 and sum(p.batch.num_rows for p in parts) == len(texts)
