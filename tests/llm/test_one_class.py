"""Models that learned of one class, or in other scripts than a text's."""

from colophon.llm import language, toxicity

SCHEMA = "doc_id long, text string, lang string"


def test_labels_of_one_class_say_that_class(spark):
    documents = spark.createDataFrame([(i, f"word{i} more words", "en") for i in range(20)] + [(99, None, None)], SCHEMA)
    for toxic, wanted in ((0, 0), (1, 1)):
        labels = spark.createDataFrame([(i, toxic) for i in range(20)], "doc_id long, toxic int")
        assert {r["predicted"] for r in toxicity.judge_toxicity(documents, labels).collect()} == {wanted}
    assert {r["predicted"] for r in toxicity.judge_toxicity(documents, labels.limit(0)).collect()} == {0}


def test_scripts_without_a_learned_language_score_next_to_nothing(spark):
    learned = [(i, "the house and the garden are here" if i % 2 else "das haus und der garten sind hier", "en" if i % 2 else "de") for i in range(40)]
    texts = [(100, "ภาษาไทยเป็นภาษา", None), (101, "это русский текст", None), (102, "the garden", None), (103, "the garden это русский текст и еще слова", None), (104, "123", None)]
    documents = spark.createDataFrame(learned + texts, SCHEMA)
    model = language.train(documents)
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.label_languages(documents, model).collect()}
    assert found[100][1] < 0.01 and found[101][1] < 0.01 and found[102][0] == "en" and found[102][1] > 0.5
    assert found[103][0] == "en" and found[103][1] < found[102][1] and found[104] == ("und", 0.0)
    kept = {r["doc_id"] for r in language.in_known_language(documents.where("doc_id >= 100"), model, 0.25).collect()}
    assert 102 in kept and not kept & {100, 101, 104}


def test_without_a_learned_language_all_texts_with_letters_stay(spark):
    documents = spark.createDataFrame([(1, "some text", None), (2, "...", None), (3, None, None)], SCHEMA)
    assert [r["doc_id"] for r in language.in_known_language(documents, language.train(documents), 0.25).collect()] == [1]
