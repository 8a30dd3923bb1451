import datetime
import random

import pytest
from pyspark.sql import functions as F

from duelytics.constants import BENCHMARK_DEFAULTS
from duelytics.operators import metrics, trends

MODELS = [("gpt", "4"), ("gpt", "5"), ("phi", "4"), ("yi", "34b"), ("abc", "")]
CONV = (
    "base_model_a string, version_a string, base_model_b string, version_b string, conv_turns int,"
    " visitor_id string, timestamp timestamp_ntz, mode string,"
    " custom_models_selection array<string>, categories array<string>, keywords array<string>,"
    " languages array<string>, model_a_total_params double, model_b_total_params double,"
    " total_conv_a_kwh double, total_conv_b_kwh double, total_conv_a_output_tokens long,"
    " total_conv_b_output_tokens long, chosen_base_model string, both_equal boolean"
)


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    out = []
    for i in range(300):
        a, b = rng.choice(MODELS), rng.choice(MODELS)
        custom = rng.random() < 0.4
        out.append((
            *a, *b, rng.randint(1, 5), rng.choice(["u1", "u2", "u3", None]),
            datetime.datetime(2024, rng.randint(1, 3), 1 + i % 28),
            "custom" if custom else "random",
            rng.choice([["GPT-4", "x"], ["phi-4"], None, [None, "yi-34"]]) if custom else None,
            rng.choice([["Art", "Science"], ["Art", None], [], None]),
            rng.choice([["A", "b"], ["c"], None]),
            rng.choice([["fr"], ["en"], ["en", "fr"]]),
            rng.choice([7.0, 70.0, None]), rng.choice([7.0, 8.0, None]),
            rng.randint(0, 900) / 100, rng.choice([None, rng.randint(0, 900) / 100]),
            rng.randint(0, 500), rng.choice([None, rng.randint(0, 500)]),
            rng.choice([a[0], b[0], None]), rng.choice([True, False, None]),
        ))
    return out


@pytest.fixture(scope="module")
def conv(spark, data):
    return spark.createDataFrame(data, CONV).repartition(5).cache()


def models():
    return [(f, "Tous") for f in {m[0] for m in MODELS}] + [m for m in MODELS if m[1]]


def sides(row, model):
    return [(row[0], row[1] if model[1] != "Tous" else "Tous") == model,
            (row[2], row[3] if model[1] != "Tous" else "Tous") == model]


def played(data, model):
    return [r for r in data if any(sides(r, model))]


def by_model(df, *columns):
    return {(r.family, r.version): tuple(r[c] for c in columns) for r in df.collect()}


def mean(values):
    values = [v for v in values if v is not None]
    return sum(values) / len(values) if values else None


def test_duel_totals(conv, data):
    got = by_model(metrics.model_metrics(conv, conv),
                   "conversations", "visitors", "turns_total", "kwh_total", "tokens_total",
                   "winrate", "total_params")
    assert set(got) == set(models())
    for model, (n, visitors, turns, kwh, tokens, winrate, params) in got.items():
        duels = played(data, model)
        assert n == len(duels)
        assert visitors == len({r[5] for r in duels})
        assert turns == sum(r[4] for r in duels)
        own = [[r[i + s] or 0 for r in duels for s in (0, 1) if sides(r, model)[s]] for i in (14, 16)]
        assert kwh == pytest.approx(sum(own[0]), abs=0.006)
        assert tokens == sum(own[1])
        wins = sum(r[18] == model[0] and not r[19] for r in duels)
        draws = sum(r[19] is True for r in duels)
        assert winrate == pytest.approx(100 * (wins + draws / 2) / len(duels), abs=0.0051)
        if model[1] == "Tous":
            assert params is None
        else:
            values = [r[12] for r in duels if r[0] == model[0]] + [r[13] for r in duels if r[2] == model[0]]
            values = [v for v in values if v is not None]
            best = max(values.count(v) for v in values)
            assert params == min(v for v in values if values.count(v) == best)


def test_means(conv, data):
    totals = metrics.duel_totals(conv)
    energy = by_model(metrics.energy(totals), "kwh_avg")
    tokens = by_model(metrics.tokens(totals), "tokens_avg")
    turns = by_model(metrics.turns(totals), "turns_avg")
    deep = by_model(metrics.deep_engagement(totals), "deep_engagement")
    for model in models():
        duels = played(data, model)
        first = [[r[i] if r[0] == model[0] else r[i + 1] for r in duels] for i in (14, 16)]
        assert energy[model][0] == pytest.approx(mean(first[0]), abs=0.00051)
        assert tokens[model][0] == pytest.approx(mean(first[1]), abs=0.00051)
        twice = [r[4] for r in duels for s in sides(r, model) if s]
        assert turns[model][0] == pytest.approx(mean(twice), abs=0.0051)
        assert deep[model][0] == pytest.approx(100 * mean([r[4] > 2 for r in duels]), abs=0.051)


def test_pick_rate(conv, data):
    got = by_model(metrics.pick_rate(metrics.duel_totals(conv, ["picks"]), conv), "pick_rate", "pick_rate_delta")
    custom = [r for r in data if r[7] == "custom"]
    for model in models():
        asked = [r for r in custom if any(sides(r, model)) and r[8]
                 and model[0] in " ".join(x for x in r[8] if x).lower()]
        rate = 100 * len(asked) / len(custom)
        assert got[model][0] == pytest.approx(rate, abs=0.051)
        assert got[model][1] == pytest.approx(rate - 3.7, abs=0.06)


def test_pick_rate_without_custom_duels(conv):
    plain = conv.withColumn("mode", F.lit("random"))
    got = metrics.pick_rate(metrics.duel_totals(plain, ["picks"]), plain)
    assert {r.pick_rate for r in got.collect()} == {0.0}


def test_energy_total_adds_up(conv, data):
    got = by_model(metrics.energy(metrics.duel_totals(conv)), "kwh_total")
    families = sum(v[0] for k, v in got.items() if k[1] == "Tous")
    assert families == pytest.approx(sum((r[14] or 0) + (r[15] or 0) for r in data), abs=0.05)


def test_structure_and_kpis(conv, data):
    got = {(r.family, r.version) for r in metrics.model_structure(conv).collect()}
    assert got == {(f, v or None) for f, v in MODELS}
    assert tuple(metrics.home_kpis(conv).first()) == (len(data), 4)


def test_ranking_ties_and_missing(spark):
    scores = spark.createDataFrame(
        [("b", "Tous", 50.0), ("a", "Tous", 50.0), ("c", "Tous", 70.5), ("d", "Tous", None),
         ("e", "Tous", 10.0), ("c", "1", 99.0), ("z", "Tous", 99.0)],
        "family string, version string, winrate double")
    listed = spark.createDataFrame([(x,) for x in "abcde"], "family string")
    got = {r.family: (r.position, r.n, r.progress) for r in metrics.ranking(scores, listed).collect()}
    assert got == {"c": (1, 4, 1.0), "a": (2, 4, 0.75), "b": (3, 4, 0.5), "e": (4, 4, 0.25)}


def test_topics(conv, data):
    got = by_model(trends.topic_pairs(conv, n=2).filter("rank = 1"), "n")
    for model in models():
        counts = {}
        for r in played(data, model):
            if "fr" in r[11]:
                for c in r[9] or []:
                    for k in r[10] or []:
                        if c:
                            counts[c.lower(), k.lower()] = counts.get((c.lower(), k.lower()), 0) + 1
        assert got[model][0] == max(counts.values())
    top = trends.top_categories(trends.topic_pairs(conv), k=1)
    assert {r["count(DISTINCT category)"] for r in top.groupBy("family", "version").agg(F.countDistinct("category")).collect()} == {1}


def test_monthly(conv, data):
    shares = trends.tokens_monthly(conv)
    sums = by_model(shares.groupBy("family", "version").agg(F.sum("frequency").alias("s")), "s")
    assert all(v[0] == pytest.approx(100) for v in sums.values())
    months = {(r.family, r.version, r.month): r.winrate for r in trends.winrate_monthly(conv).collect()}
    for model in models():
        for month in (1, 2, 3):
            score = [0.5 if r[19] else float(r[18] == model[0])
                     for r in played(data, model) if r[6].month == month
                     for s in sides(r, model) if s]
            assert months[(*model, f"2024-0{month}")] == pytest.approx(100 * mean(score), abs=0.0051)
    joined = trends.trend(shares, trends.winrate_monthly(conv))
    assert joined.count() == shares.count()


def test_monthly_without_tokens(conv):
    none = conv.withColumns({c: F.lit(0) for c in metrics.TOKENS["tokens"]})
    assert trends.tokens_monthly(none).count() == 0


REACT = "model string, version string, liked boolean, useful boolean, creative boolean, clear_formatting boolean, instructions_not_followed boolean, incorrect boolean, superficial boolean"


def reactions(spark, data):
    return spark.createDataFrame(data, REACT)


def test_reaction_metrics(spark):
    react = reactions(spark, [
        ("gpt", "4", True, True, False, False, False, False, False),
        ("gpt", "5", None, True, True, False, False, True, False),
        ("gpt", "", False, None, True, False, True, True, False),
        (None, None, True, True, True, True, True, True, True)])
    got = by_model(metrics.reaction_metrics(react), "reactions", "satisfaction", "useful_mean", "creative_mean")
    assert got == {
        ("gpt", "Tous"): (3, 50.0, 1.0, pytest.approx(2 / 3)),
        ("gpt", "4"): (1, 100.0, 1.0, 0.0),
        ("gpt", "5"): (1, None, 1.0, 1.0)}


def test_benchmarks_defaults(spark, conv):
    empty = metrics.benchmarks(reactions(spark, []), conv).first().asDict()
    assert empty == BENCHMARK_DEFAULTS
    react = reactions(spark, [("gpt", "4", True, True, False, False, False, False, False)])
    zero = conv.withColumns({c: F.lit(0) for c in metrics.TOKENS["tokens"]})
    got = metrics.benchmarks(react, zero).first()
    assert got.tokens == 500.0 and got.useful == 1.0 and 1 < got.turns < 5


def test_zero_error_rate_earns_no_badge(spark, conv):
    flawless = ("gpt", "4", True, True, False, False, False, False, False)
    flawed = ("phi", "4", True, False, False, False, True, True, True)
    better = ("yi", "34b", True, False, False, False, True, True, False)
    good = ("yi", "34b", True, False, False, False, False, False, False)
    react = reactions(spark, [flawless, flawed, better, good, good, good])
    out = metrics.badges(metrics.reaction_metrics(react), metrics.duel_totals(conv),
                         metrics.winrate(conv), metrics.benchmarks(react, conv))
    got = {k: set(v[0]) for k, v in by_model(out, "badges").items()}
    assert "Utile" in got["gpt", "4"]
    assert not {"Discipliné", "Précis", "Fiable"} & got["gpt", "4"]
    assert {"Discipliné", "Précis"} <= got["yi", "34b"]
    assert not {"Discipliné", "Précis", "Fiable"} & got["phi", "4"]


def test_prices(spark):
    listing = [
        (0, "openai/gpt-4o-mini", "0.0000006"), (1, "openai/GPT-4.1-mini", "0.0000016"),
        (2, "anthropic/claude-3-5-sonnet", "0.000015"), (3, "x/phi-4:free", "0"),
        (4, "x/glm-4.5", None), (5, "x/yi-1.5", "abc"), (6, "y/gpt-4.1-mini-b", "0.5"),
        (7, "q", "1"), (8, "", "1")]
    prices = spark.createDataFrame(listing, "position int, id string, completion string")
    models = spark.createDataFrame(
        [("gpt", "Tous"), ("gpt", "4.1-mini"), ("gpt", "9"), ("claude", "Tous"), ("phi", "Tous"),
         ("phi", "4"), ("glm", "Tous"), ("yi", "Tous"), ("yi", "1.5"), ("zzz", "Tous"), ("q", "Tous")],
        "family string, version string")
    got = by_model(metrics.price_per_token(models, prices), "price", "is_free")
    assert got == {
        ("gpt", "Tous"): (round((0.0000006 + 0.0000016 + 0.5) / 3, 6), False),
        ("gpt", "4.1-mini"): (0.0000016, False),
        ("claude", "Tous"): (0.000015, False),
        ("phi", "Tous"): (0.0, True), ("phi", "4"): (0.0, False),
        ("glm", "Tous"): (0.0, True),
        ("yi", "Tous"): (0.0, False), ("yi", "1.5"): (0.0, False),
        ("q", "Tous"): (1.0, False)}


def test_small_energies_are_not_lost(spark):
    duels = spark.range(100_000).selectExpr(
        "'x' base_model_a", "'y' base_model_b", "'1' version_a", "'1' version_b", "4e-7D total_conv_a_kwh",
        "id * 1e-12D total_conv_b_kwh")
    got = by_model(metrics.energy(metrics.duel_totals(duels, ["kwh", "kwh_first", "kwh_n"])), "kwh_total")
    assert got["x", "Tous"] == (0.04,) and got["y", "Tous"] == (0.0,)
    sums = {r.family: r.kwh for r in metrics.duel_totals(duels, ["kwh"]).collect()}
    assert float(sums["x"]) == 0.04 and float(sums["y"]) == pytest.approx(4.99995e-3, rel=1e-12)


@pytest.mark.parametrize("absent", ["conv_turns", "mode", "custom_models_selection"])
def test_metrics_without_a_column(spark, absent):
    duels = spark.sql("""SELECT 'x' base_model_a, 'y' base_model_b, '1' version_a, '1' version_b, 1.5D total_conv_a_kwh,
        2.5D total_conv_b_kwh, 10L total_conv_a_output_tokens, 20L total_conv_b_output_tokens, 3L conv_turns, 'custom' mode,
        array('x') custom_models_selection""").drop(absent)
    totals = metrics.duel_totals(duels)
    assert by_model(metrics.energy(totals), "kwh_total")["x", "Tous"] == (1.5,)
    picks = by_model(metrics.pick_rate(totals, duels), "pick_rate")
    deep = by_model(metrics.deep_engagement(totals), "deep_engagement")
    assert picks["x", "Tous"] == ((100.0,) if absent == "conv_turns" else (0.0,))
    assert deep["x", "Tous"] == ((0.0,) if absent == "conv_turns" else (100.0,))
