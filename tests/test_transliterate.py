"""Transliteration by hand-written readings, and places of search forms."""

import random

import pytest

from colophon.functions import transliterate as R


@pytest.mark.parametrize(
    "kana,romaji",
    [("にっぽん", "nippon"), ("とうきょう", "tokyo"), ("コーヒー", "kohi"), ("シャーマン", "shaman"), ("ファイル", "fairu"), ("クヮ", "kwa"), ("っっか", "kka"), ("ジュース", "jusu"), ("ヴァイオリン", "vaiorin"), ("バチェラー", "bachera"), ("ちゃっちゃ", "chaccha"), ("ァア", "a"), ("ンー", "n"), ("ティ", "ti"), ("きゃぁ", "kya"), ("ー", ""), ("んん", "nn"), ("っん", "n"), ("ヵ", "ka")],
)
def test_hepburn(kana, romaji):
    assert R.kana_to_romaji(kana) == romaji


@pytest.mark.parametrize(
    "text,form",
    [("アイヌ・イタㇰ", "ainu itak"), ("ガギ ｶﾞ", "gagi ga"), ("セ゚ト゚ツ゚ㇷ゚", "cetutup"), ("ウェンペ", "wenpe"), ("チャペ", "cape"), ("Ḱamúy’s Straße", "kamuy's strasse"), ("ΟΔΟΣ", "οδοσ"), ("a`b´cʹdʼe՚f‘g’h‛i＇j", "a'b'c'd'e'f'g'h'i'j"), ("が", "ga"), ("", ""), ("漢字カナ", "漢字kana")],
)
def test_search_form(text, form):
    assert R.search_text(text) == form


def test_pieces_make_the_form_and_cover_the_text():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choice("アィイッンー・゙゚ｶﾞぷ゚ㇷabÉß’Σ漢\U0001f600 ́") for _ in range(rng.randint(0, 15)))
        pieces = R.search_pieces(text)
        assert "".join(p for p, _, _ in pieces) == R.search_text(text)
        at = 0
        for _, a, b in pieces:
            assert a == at < b
            at = b
        assert at == len(text)


def test_slugs():
    assert R.slug_of("Санкт-Петербург: Щука и объезд") == "sankt-peterburg-shchuka-i-obezd"
    assert R.slug_of("Łódź ‘don't’ Ærø") == "lodz-dont-aero" and R.slug_of("漢字") == "" and R.slug_of("ＡＢ ﾊﾞﾁｪﾗｰ") == "ab-bachera"
    assert R.slug_of("word " * 30) == "-".join(["word"] * 12) and R.slug_of("x" * 80) == "x" * 60


def test_columns(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("カムイ と kamúi",), (None,), ("",)], "t string")
    got = rows.select(R.folded_ranges("Kamui")("t").alias("r"), R.fold("t").alias("f"), R.slug("t").alias("s"), R.folded_places(F.col("t")).alias("p"), R.folded_ends(F.col("t")).alias("e")).collect()
    assert [tuple(x) for x in got[0]["r"]] == [(0, 3), (6, 11)] and got[0]["f"] == "kamui to kamui" and got[0]["s"] == "kamui-to-kamui"
    assert got[0]["p"][:3] == [0, 0, 1] and got[0]["e"][:3] == [1, 1, 2] and got[1]["r"] is None and got[2]["r"] == []
