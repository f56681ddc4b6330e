import pytest
from pyspark.sql import functions as F

from quern.llm import mojibake as m

CLEAN = ["Die Prüfung für Größe ist überlastet.", "It’s noted — don’t drop “it”.", "décale le relevé à l’étape", "我们为 它 测得 毫秒，为 它", "CAFÉ café naïve Ångström ÂGE ÊTRE", "• eins", "für Größe décale", "“Nobody “The", "Запись обновлена, Η ουρά", "emoji 🔁 and x²"]


def broken(text, *chain):
    for written, read in zip(chain[::2], chain[1::2]):
        data = text.encode(written)
        text = m._read(data, read) if read in m._TABLES else data.decode(read, "replace")
    return text


GARBLED = {
    100: (("utf_8", "cp1252"), "für Größe"), 101: (("utf_8", "latin_1"), "It’s noted"), 102: (("utf_8", "cp1252", "utf_8", "cp1252"), "le relevé"), 103: (("cp1252", "mac_roman"), "café décale"),
    104: (("utf_8", "cp437"), "décale"), 105: (("cp1252", "utf_8"), "überlastet"), 106: (("utf_8", "gbk"), "It’s noted"), 107: (("utf_8", "cp1252"), "测得 毫秒，为"), 108: (("gbk", "cp1251"), "我们为 测得"),
    109: (("cp1252", "cp850"), "Größe"), 110: (("utf_8", "cp1252"), "• x"),
}


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(10 * n + i, t) for i, t in enumerate(CLEAN) for n in range(3)]
    rows += [(i, f"some words {broken(t, *chain)} and more") for i, (chain, t) in GARBLED.items()]
    rows += [(200, None), (201, ""), (202, "plain"), (203, "lost �� here"), (None, "fÃ¼r"), (204, "ß" * 50_000)]
    return spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("token", F.lit("clash")).withColumn("chain", F.lit("clash"))


def test_found_and_restored(spark, docs):
    got = m.garbled_tokens(docs).collect()
    assert {r["doc_id"] for r in got} == {*GARBLED, 203}
    texts = {r["doc_id"]: r for r in m.restore_texts(docs).collect()}
    for i, (_, t) in GARBLED.items():
        assert texts[i]["restored"] == f"some words {t} and more", i
        assert texts[i]["n_left"] == 0
    assert texts[203]["n_left"] == 1 and texts[203]["restored"] == "lost �� here"


def test_empty(spark, docs):
    assert m.garbled_tokens(docs.limit(0)).count() == 0 and m.garbled_tokens(docs.filter("doc_id = 202")).count() == 0


def test_forms():
    forms = m.garbled_forms("für")
    assert forms["fÃ¼r"] == "utf_8>cp1252" and forms["f�r"] == "cp1252>utf_8" and "für" not in forms
    assert set(forms.values()) <= set(m.CHAINS)
    assert m.garbled_forms(m.OPENING + "“") == {m.OPENING + "ì": "cp1252>mac_roman", m.OPENING + "ô": "cp1252>cp437"} or m.OPENING + "ì" in m.garbled_forms(m.OPENING + "“")


def test_tokens_of_a_text():
    assert m.text_tokens("plain", {}) == set()
    got = m.text_tokens("It’s a ò x ìNobody 页。¾Ý", {})
    assert {"It’s", "’", "ò", m.LONE + "ò", "ìNobody", "ì", m.OPENING + "ì", "页。¾Ý", "¾Ý"} <= got and m.LONE + "ì" not in got


def test_undo_needs_a_chain_and_a_round_trip():
    token = broken("größte", "utf_8", "cp1252")
    assert m._undo(token, {"utf_8>cp1252"}) == "größte" and m._undo(token, {"utf_8>cp437"}) is None and m._undo("größte", {"utf_8>cp1252"}) is None


def test_hot_source_garbled_more_often_than_clean(spark):
    """One source with most rows was decoded wrongly: garbled forms are as frequent as the words or more so, and words stay words."""
    clean = [(1, "Die Größe ist für überlastet"), (2, "我们为它 ok 测得毫秒"), (3, "on décale ici"), (4, "día ²")]
    hot = [(100 + i, broken("Größe für überlastet", "cp1252", "mac_roman")) for i in range(4)]
    hot += [(200 + i, broken("我们为它 ok 测得毫秒", "gbk", "cp1252")) for i in range(4)] + [(300, broken("on décale ici", "cp1252", "mac_roman"))]
    docs = spark.createDataFrame(clean + hot, "doc_id bigint, text string")
    texts = {r["doc_id"]: r["restored"] for r in m.restore_texts(docs).collect()}
    assert set(texts) == {i for i, _ in hot}
    assert texts[100] == "Größe für überlastet" and texts[200] == "我们为它 ok 测得毫秒" and texts[300] == "on décale ici"


def test_chain_of_the_document_decides_what_may_be_meant(spark):
    """schšn might be meant and is as frequent as schön; beside a certain token of the same chain it is garbled, alone it is not told."""
    docs = spark.createDataFrame([(1, "schön größer"), (2, broken("schön größer", "mac_roman", "cp1252")), (3, "schšn")], "doc_id bigint, text string")
    assert {r["doc_id"]: r["restored"] for r in m.restore_texts(docs).collect()} == {2: "schön größer"}


def test_chinese_sentence_that_stands_nowhere_else(spark):
    """The run is known by its pairs of ideographs only; Cyrillic, which is Chinese by its bytes, and Chinese as meant are left."""
    clean = [(1, "我们为它测得毫秒，再丢弃其余部分。"), (2, "日志里没有过期的页面"), (3, "Запись обновлена Было сделано"), (4, "日本 ok 页面")]
    sentence = "再测得过期的毫秒。"
    bad = {10: ("gbk", "cp1252"), 11: ("gbk", "cp1251"), 12: ("utf_8", "mac_roman"), 13: ("utf_8", "cp437"), 14: ("gbk", "latin_1")}
    docs = spark.createDataFrame(clean + [(i, broken(sentence, *chain)) for i, chain in bad.items()], "doc_id bigint, text string")
    assert {r["doc_id"]: r["restored"] for r in m.restore_texts(docs).collect()} == {i: sentence for i in bad}


def test_any_two_or_three_readings_in_a_row(spark):
    """Orders of encodings that the table of forms leaves out, with words whose once garbled form stands nowhere."""
    chains = {10: ("mac_roman", "cp1252"), 11: ("cp437", "latin_1"), 12: ("iso8859_15", "mac_roman"), 13: ("koi8_r", "cp1251"), 14: ("mac_roman", "cp850", "latin_1")}
    bad = {i: broken("für größte", *(x for read in reads for x in ("utf_8", read))) for i, reads in chains.items()}
    docs = spark.createDataFrame([(1, "für"), (2, "größte"), *bad.items()], "doc_id bigint, text string")
    assert {r["doc_id"]: r["restored"] for r in m.restore_texts(docs).collect()} == {i: "für größte" for i in bad}


def test_lone_letters_are_words_where_the_text_has_others(spark):
    """Vocatives and conjunctions of one letter stay; where nothing else is beyond ASCII, a letter in the place of a bullet or quote doesn't."""
    rows = [(1, "Ô toi qui lis, ô ami"), (2, "perché ò già"), (3, "à la carte"), (4, "le relevé à l’étape"), (5, "il va à Orléans"), (6, "½ cup"), (7, "ô ami très cher"), (8, "ô ami très cher"), (9, "es así"), (10, "así es más así"), (11, "señor")]
    bad = [(20, broken("• one", "cp1252", "mac_roman")), (21, broken("“The end” they said", "cp1252", "cp437")), (22, broken("« yes » no", "cp1252", "cp437")), (23, broken("so it went… And", "cp1252", "mac_roman"))]
    docs = spark.createDataFrame(rows + bad, "doc_id bigint, text string")
    got = {r["doc_id"]: r["restored"] for r in m.restore_texts(docs).collect()}
    assert {i: got.get(i) for i in (20, 21)} == {20: "• one", 21: "“The end” they said"} and set(got) == {20, 21, 22, 23} and got[23] == "so it went… And"


def test_a_garbled_form_more_frequent_than_its_word(spark):
    rows = [(1, "Die Größe passt"), *((i, "Die Grˆﬂe passt") for i in (2, 3, 4))]
    got = {r["doc_id"]: r["restored"] for r in m.restore_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {i: "Die Größe passt" for i in (2, 3, 4)}


def test_every_find_says_how(spark, docs):
    by = {r["found_by"] for r in m.garbled_tokens(docs).collect()}
    assert {"form", "lost"} <= by <= {"form", "pairs", "alone", "lost"}


def test_one_garbled_passage_turns_no_word_of_clean_text(spark):
    """A document with a certain chain and clean words elsewhere: its apostrophe stays, and the rare form of the frequent word is garbled."""
    rows = [(i, "I don’t know") for i in range(9)] + [(20, "ça garçon été"), (21, broken("ça garçon", "utf_8", "cp1252")), (30, f"don’t {broken('garçon', 'mac_roman', 'cp1252')} {broken('ça', 'mac_roman', 'cp1252')}")]
    rows += [(40, broken("I don’t know", "cp1252", "mac_roman")), (41, f"a {broken('été', 'gbk', 'cp1252')}"), (42, f"I {broken('don’t', 'gbk', 'cp1252')} know")]
    got = {r["doc_id"]: r["restored"] for r in m.restore_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[40] == "I don’t know" and got[21] == "ça garçon" and got[42] == "I don’t know" and got[41] == "a été" and not set(got) & set(range(9))
    assert got.get(30, "don’t").startswith("don’t")


def test_nothing_that_grows_is_broadcast(spark, docs, monkeypatch, tmp_path):
    """Whatever the engine guesses, forms and pairs are joined by a shuffle, and so are finds unless their counted rows are few."""
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    written, cut = [], m.cut_lineage
    monkeypatch.setattr(m, "cut_lineage", lambda df: written.append(df._jdf.queryExecution().sparkPlan().toString()) or cut(df))
    monkeypatch.setattr(m, "FEW", -1)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
        got = {r["doc_id"] for r in m.garbled_tokens(docs).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert got == {*GARBLED, 203}
    joins = [line for plan in written for line in plan.splitlines() if "Join" in line]
    assert not [j for j in joins if "BroadcastHashJoin" in j and ("[h#" in j or "[pair#" in j or "[token#" in j)]
    assert sum("SortMergeJoin [h#" in j for j in joins) == 1 and sum("SortMergeJoin [pair#" in j for j in joins) == 1
