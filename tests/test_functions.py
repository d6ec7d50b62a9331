"""Golden rows of the column functions."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from storyspark.functions import anchors as A
from storyspark.functions import deltas as D
from storyspark.functions import fixed_values as fixed
from storyspark.functions import scores as S
from storyspark.functions import states as ST
from storyspark.functions import taxonomy as T
from storyspark.functions import text as X
from storyspark.operators import evidence, neardup

NOW = dt.datetime(2024, 5, 1, 12, 0, 0)


def values(spark, rows, schema, column):
    """The column's value for each input row, in input order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["v"] for r in df.select("i", column.alias("v")).orderBy("i").collect()]


ANCHOR_CASES = [
    (
        "PEC 45/2019 custa R$ 1.000,00, CPF 111.222.333-44",
        [("CPF", "111.222.333-44"), ("PL", "PEC 45/2019"), ("VALOR", "R$ 1.000,00")],
        1.3,
    ),
    ("ACÓRDÃO 5/6", [("TCU", "ACÓRDÃO 5/6")], 2.0),
    ("por R$ 50.", [("VALOR", "R$ 50.")], 0.2),
    ("XPEC 8", [("PL", "PEC 8")], 1.0),
    ("Acórdão 1/2 " * 6, [("TCU", "Acórdão 1/2")] * 6, 10.0),
    ("", [], 0.0),
    ("R$ 10", [("VALOR", "R$ 10")], 0.2),
    ("pl\n12", [("PL", "pl\n12")], 1.0),
    (
        "12.345.678/0001-90 1234567-12.2024.8.26.0100 12345.000001/2024-11 decreto nº 3/2020",
        [
            ("CNPJ", "12.345.678/0001-90"),
            ("CNJ", "1234567-12.2024.8.26.0100"),
            ("SEI", "12345.000001/2024-11"),
            ("ATO", "decreto nº 3/2020"),
        ],
        4.0,
    ),
]


def test_anchors_and_evidence(spark):
    docs = spark.createDataFrame(
        [(i, case[0], False, "") for i, case in enumerate(ANCHOR_CASES)],
        "doc_id bigint, clean_text string, is_official boolean, url string",
    )
    rows = evidence.extract_anchors(docs)
    found = rows.orderBy("doc_id", "anchor_no").collect()
    for i, (_, anchors, _) in enumerate(ANCHOR_CASES):
        assert [(r.anchor_type, r.anchor_value) for r in found if r.doc_id == i] == anchors
    features = {r.doc_id: r for r in evidence.evidence_features(docs).collect()}
    for i, (_, anchors, score) in enumerate(ANCHOR_CASES):
        assert features[i].evidence_score == pytest.approx(score)
        assert features[i].anchors_count == len(anchors)


def test_anchor_context_matches_offsets(spark):
    text = "lead R$ 10,00 mid R$ 7 tail end of the text"
    dense = "R$ 1R$ 2R$ 3R$ 4R$ 5R$ 6R$ 7R$ 8R$ 9R$ 10 x" + "y" * 30 + "R$ 11"
    for sample in (text, dense, "ã" * 25 + " R$ 5 " + "é" * 25, "R$ 5", "R$." * 20):
        want = []
        at = 0
        value = __import__("re").compile(r"R\$\s*[\d.]+(?:,\d{2})?", 2)
        for m in value.finditer(sample):
            want.append(sample[max(0, m.start() - 20) : m.end() + 20])
            at = m.end()
        (got,) = values(spark, [(sample,)], "t string", A.anchor_array_with_context(F.col("t")))
        assert [a.evidence_ptr for a in got if a.anchor_type == "VALOR"] == want, (sample, at)


@pytest.mark.parametrize(
    "tier, velocity, count, age, score, codes",
    [
        (1, 0, 1, 0.0, 19.00, ["TIER_WEIGHT"]),
        (1, 6, 3, 0.0, 30.93, ["VELOCITY_SPIKE", "TIER_WEIGHT", "DIVERSITY"]),
        (3, 0, 1, 2.0, 5.52, ["DECAY"]),
        (2, 10, 4, 0.5, 24.91, ["VELOCITY_SPIKE", "DIVERSITY", "DECAY"]),
        (1, 105, 105, 0.0, 70.06, ["VELOCITY_SPIKE", "TIER_WEIGHT", "DIVERSITY"]),
    ],
)
def test_breaking_score(spark, tier, velocity, count, age, score, codes):
    first = NOW - dt.timedelta(hours=age)
    args = F.col("tier"), F.col("v"), F.col("n"), F.col("first"), F.col("now")
    both = F.struct(S.breaking_score(*args).alias("s"), S.breaking_reasons(*args).alias("r"))
    row = [(tier, velocity, count, first, NOW)]
    (got,) = values(spark, row, "tier int, v bigint, n bigint, first timestamp, now timestamp", both)
    assert got.s == pytest.approx(score, abs=1e-9)
    assert got.r == [f"PLANTAO_{c}" for c in codes]
    assert (got.s > 70.0) == (score > 70.0)


def test_breaking_score_falls_with_age(spark):
    rows = [(NOW - dt.timedelta(minutes=m),) for m in range(-60, 600, 30)]
    score = S.breaking_score(F.lit(1), F.lit(3), F.lit(2), F.col("t"), F.lit(NOW))
    got = values(spark, rows, "t timestamp", score)
    assert got == sorted(got, reverse=True) and got[0] > got[2]


@pytest.mark.parametrize(
    "evidence_score, tier1, official, score, codes",
    [
        (0.0, False, False, 15.0, ["COVERAGE_LAG"]),
        (4.0, False, True, 36.0, ["EVIDENCE_STRONG", "COVERAGE_LAG", "OFFICIAL_SOURCE"]),
        (10.0, False, True, 60.0, ["EVIDENCE_STRONG", "COVERAGE_LAG", "OFFICIAL_SOURCE"]),
        (3.0, True, False, 8.0, []),
        (3.5, True, True, 17.0, ["EVIDENCE_STRONG", "OFFICIAL_SOURCE"]),
    ],
)
def test_gap_score(spark, evidence_score, tier1, official, score, codes):
    args = F.col("e"), F.col("t"), F.col("o")
    both = F.struct(S.gap_score(*args).alias("s"), S.gap_reasons(*args).alias("r"))
    (got,) = values(spark, [(evidence_score, tier1, official)], "e double, t boolean, o boolean", both)
    assert got.s == pytest.approx(score)
    assert got.r == [f"OCEANO_{c}" for c in codes]


def test_editorial_lane(spark):
    cases = [
        ({"title": "Copom mantém Selic"}, "economia"),
        ({"title": "STF julga Congresso"}, "justica"),
        ({"title": "Mercado e Senado"}, "politica"),
        ({"title": "Polícia prende suspeito"}, "saude"),
        ({"explicit_lane": "Hardnews "}, "hardnews"),
        ({"editoria": "Meio Ambiente"}, "meio_ambiente"),
        ({"title": "Nota", "source_scope": "Federal"}, "politica"),
        ({"title": "Nota", "topic": "Cultura", "editoria": "Saude"}, "cultura"),
        ({}, "geral"),
    ]
    names = ("explicit_lane", "editoria", "topic", "title", "snippet", "source_scope")
    rows = [tuple(kwargs.get(n) for n in names) for kwargs, _ in cases]
    schema = ", ".join(f"{n} string" for n in names)
    lane = T.editorial_lane(**{n: F.col(n) for n in names})
    assert values(spark, rows, schema, lane) == [want for _, want in cases]
    folded = T.editorial_lane(title=F.col("title"), without_accents=True)
    assert values(spark, [("Polícia na prisão",)], "title string", folded) == ["seguranca"]


def test_source_class_and_media_group(spark):
    cases = [
        (None, "https://www12.senado.leg.br/x", None, "primary"),
        (None, "https://www.jota.info/feed", None, "specialized"),
        (None, "https://folha.uol.com.br/", None, "competitor"),
        (None, "https://www.poder360.com.br/", None, "independent"),
        ("Poder360", None, None, "specialized"),
        ("x", "https://notgov.br.example.com/", None, "other"),
        ("Prefeitura de X", None, None, "primary"),
        (None, "https://x.com", "Competitor", "competitor"),
    ]
    column = T.source_class(F.col("n"), F.col("u"), F.col("c"))
    got = values(spark, [c[:3] for c in cases], "n string, u string, c string", column)
    assert got == [c[3] for c in cases]
    hosts = [("www.folha.uol.com.br",), ("uol.com.br",), ("nodal.am",), ("x.org",), ("",)]
    groups = values(spark, hosts, "h string", T.media_group(F.col("h")))
    assert groups == ["folha", "uol", "nodal", None, None]
    main = values(spark, hosts, "h string", T.is_mainstream(T.media_group(F.col("h"))))
    assert main == [True, True, False, False, False]


def test_text_functions(spark):
    assert values(spark, [("  Á  b\n\tC ",), (None,)], "t string", X.normalize_text(F.col("t"))) == ["á b c", ""]
    assert values(spark, [("Olá, Mundo! a_b ½",), ("",), (None,)], "t string", X.tokens(F.col("t"))) == [
        ["olá", "mundo", "a_b", "½"],
        [],
        [],
    ]
    sets = [(["a", "b"], ["b", "c"]), (["a"], []), ([], []), (["a", "a"], ["a"])]
    assert values(spark, sets, "a array<string>, b array<string>", X.jaccard(F.col("a"), F.col("b"))) == [
        pytest.approx(1 / 3),
        0.0,
        0.0,
        1.0,
    ]
    crons = [("* * * * *",), ("",), (None,), ("* * * *",), (" 0  * * * * ",)]
    assert values(spark, crons, "c string", X.cron_is_valid(F.col("c"))) == [True, True, True, False, True]
    table = [([["a", "", None, "b"], ["", None], ["c"]],), ([],)]
    assert values(spark, table, "t array<array<string>>", X.table_text(F.col("t"))) == [
        "\n[TABLE]\na | b\nc\n[/TABLE]\n",
        None,
    ]


def test_simhash(spark):
    cases = [
        ("a", 3585878926028121697),
        ("a b", 3513678945095583233),
        ("a a b", 3585878926028121697),
        ("O Senado aprovou o PL 1.", -6241776782339980596),
        ("O senado aprovou o PL 2!", -1485964643018456372),
        ("", 0),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id bigint, clean_text string")
    got = {r.doc_id: r.simhash for r in neardup.document_simhash(docs).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]
    pair = [(cases[3][1], cases[4][1]), (0, 0)]
    assert values(spark, pair, "a bigint, b bigint", X.simhash_similarity(F.col("a"), F.col("b"))) == [0.859375, 1.0]


def test_deltas(spark):
    (got,) = values(spark, [(["a", "b", "b"], ["b", "c"])], "o array<string>, n array<string>", D.anchor_delta(F.col("o"), F.col("n")))
    assert (got.added, got.removed) == (["c"], ["a"])
    (back,) = values(spark, [(["b", "c"], ["a", "b"])], "o array<string>, n array<string>", D.anchor_delta(F.col("o"), F.col("n")))
    assert (back.added, back.removed) == (["a"], ["c"])
    rows = [(None, None), (None, 5.0), (3.0, None), (2.0, 2.0)]
    got = values(spark, rows, "o double, n double", D.value_delta(F.col("o"), F.col("n")))
    assert got[0] is None and got[3] is None
    assert tuple(got[1]) == (None, 5.0, 5.0) and tuple(got[2]) == (3.0, None, -3.0)
    ten, noon = dt.datetime(2024, 1, 1, 10), dt.datetime(2024, 1, 1, 12)
    rows = [(ten, noon), (noon, ten), (None, noon), (None, None)]
    got = values(spark, rows, "o timestamp, n timestamp", D.temporal_delta(F.col("o"), F.col("n")))
    assert [g and g.is_postponed for g in got] == [True, False, None, None]
    assert got[0].new_time == "2024-01-01T12:00:00+00:00" and got[3] is None


def test_states(spark):
    def at(seconds):
        return NOW - dt.timedelta(seconds=seconds)

    rows = [
        ("NEW", "FAST_POOL", None),
        ("HYDRATING", "FAST_POOL", at(60)),
        ("HYDRATING", "FAST_POOL", at(60.1)),
        ("HYDRATING", "HEAVY_RENDER_POOL", at(61)),
        ("HYDRATING", "HEAVY_RENDER_POOL", at(121)),
        ("HYDRATING", "FAST_POOL", None),
        ("HOT", "FAST_POOL", at(999)),
    ]
    got = values(spark, rows, "s string, p string, t timestamp", ST.next_status(F.col("s"), F.col("p"), F.col("t"), F.lit(NOW)))
    assert got == ["HYDRATING", "HYDRATING", "PARTIAL_ENRICH", "HYDRATING", "PARTIAL_ENRICH", "HYDRATING", "HOT"]
    got = values(spark, [(19.9, 2), (20.0, 2), (19.9, 1)], "s double, n int", ST.is_quarantine_case(F.col("s"), F.col("n")))
    assert got == [True, False, False]
    got = values(spark, [(50.0, 3), (50.1, 3), (60.0, 2)], "v double, n int", ST.is_unverified_viral(F.col("v"), F.col("n")))
    assert got == [False, True, False]
    rows = [("QUARANTINE", at(900)), ("QUARANTINE", at(901)), ("HOT", at(901))]
    got = values(spark, rows, "s string, t timestamp", ST.expire_quarantine(F.col("s"), F.col("t"), F.lit(NOW)))
    assert got == ["QUARANTINE", "EXPIRED", "HOT"]


def test_decay_is_e_folding(spark):
    (got,) = values(spark, [(NOW - dt.timedelta(hours=2),)], "t timestamp", S.decay(F.col("t"), F.lit(NOW)))
    assert got == pytest.approx(math.exp(-1))


def test_pdf_links_are_found_from_the_start_of_a_run(spark):
    """A run of 60,000 characters without a link took a search from each of them."""
    rows = spark.createDataFrame([("veja a.pdf,b.PDF?c .pdf x.pdfx y.pdf.pdf\u00a0z.pdf",), ("." * 60_000,)], "t string")
    found = [r[0] for r in rows.select(A.matches(F.col("t"), "PDF", True)).collect()]
    assert found == [["a.pdf,b.PDF", "y.pdf.pdf", "z.pdf"], []]
    assert A.patterns(True)["PDF"].startswith("(?<!")


def test_lane_words_are_sought_among_distinct_words_and_phrases_in_the_text(spark):
    texts = ["o ministerio publico", "publico ministerio", "ministerio xpublico", "supertribunais do tribunal", "a a a", ""]
    counted = [sum(w in t for w in ("ministerio publico", "tribunal")) for t in texts]
    lanes = values(spark, [(t,) for t in texts], "t string", T.keyword_lane(F.col("t")))
    assert [lane == "justica" for lane in lanes] == [n > 0 for n in counted]


def test_only_gaps_other_than_a_single_space_are_replaced(spark):
    gaps = [" ", "  ", "\n", " \n", "\n ", "\t\t", "\u00a0", " \u2003 ", "\u3000", "\x85", "\u200b"]
    rows = spark.createDataFrame([(k, f"{gap}A{gap}b c{gap}") for k, gap in enumerate(gaps)], "k int, t string")
    got = {r.k: r.n for r in rows.select("k", X.normalize_text(F.col("t")).alias("n")).collect()}
    assert got == {k: "a b c" if gap != "\u200b" else "\u200ba\u200bb c\u200b" for k, gap in enumerate(gaps)}


KEYWORDS = [word for words in fixed.LANE_KEYWORDS.values() for word in words]


def test_words_are_found_wherever_they_stand(spark):
    texts = [*KEYWORDS, *(f"x{w}s" for w in KEYWORDS), *(w[:-1] for w in KEYWORDS), *(w[1:] for w in KEYWORDS), *map("".join, zip(KEYWORDS, KEYWORDS[1:]))]
    texts += ["".join(KEYWORDS), " ".join(KEYWORDS), "", "violencia policial", "agronegocio", "\U0001f600ia\U0001f600copom", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r.k: r.w for r in rows.select("k", T.words_in(F.col("t"), KEYWORDS).alias("w")).collect()}
    assert {k: set(w) for k, w in got.items()} == {k: {w for w in KEYWORDS if w in (t or "")} for k, t in enumerate(texts)}
    lanes = {r.k: r.lane for r in rows.select("k", T.keyword_lane(F.col("t")).alias("lane")).collect()}

    def lane_of(text):
        ranked = [(sum(w in text for w in words), fixed.LANE_PRIORITIES.get(lane, fixed.OTHER_LANE_PRIORITY), -k, lane) for k, (lane, words) in enumerate(fixed.LANE_KEYWORDS.items())]
        return max(ranked)[3] if max(ranked)[0] else None

    assert lanes == {k: lane_of(t or "") for k, t in enumerate(texts)}


def test_a_text_is_not_searched_once_for_each_keyword(spark):
    rows = spark.createDataFrame([("x",)], "t string").select(T.keyword_lane(F.col("t")).alias("lane"))
    assert "split(" not in rows._jdf.queryExecution().analyzed().toString()
    assert sum(T._ending(word) is None for word in KEYWORDS) <= 15
