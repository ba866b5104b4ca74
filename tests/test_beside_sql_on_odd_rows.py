"""Queries beside their SQL on rows that the small tables lack."""

import pyarrow as pa
import pyarrow.parquet as pq

from colophon.plans import QUERIES, SQL
from colophon.plans.form_queries import _tree_sql, hash_tree_nodes
from parity import TABLES, difference

FOLDER = "/root/testdata/sf0.001"


def folder_of(tmp_path, texts):
    """The small tables, with documents of some texts."""
    for t in TABLES:
        if t != "documents":
            (tmp_path / f"{t}.parquet").symlink_to(f"{FOLDER}/{t}.parquet")
    ids = list(range(len(texts)))
    columns = {"doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(ids), "source": ["web"] * len(ids), "n_chars": pa.array([len(t or "") for t in texts], pa.int64())}
    pq.write_table(pa.table(columns), tmp_path / "documents.parquet")
    return str(tmp_path)


def test_tree_of_more_rows_than_its_levels_hold(spark):
    # 6000 rows are more than 4 to the power of 3.
    assert difference(hash_tree_nodes(spark, FOLDER, fan=4), _tree_sql(fan=4), FOLDER) == ""


def test_core_text_and_scripts_of_texts_without_letters(spark, tmp_path):
    folder = folder_of(tmp_path, [None, "", "123", "!?\n\n7", "  ", "é", "ΑΣ x", "İz", "カナ", "Слово"])
    assert difference(QUERIES["core_text_and_scripts"](spark, folder), SQL["core_text_and_scripts"], folder) == ""


def test_persons_whose_names_have_no_plain_letter(spark, tmp_path):
    names = ["Èè é", "Ää ä", "Éê è", "Ann Li", "Éé Bo"]
    folder = folder_of(tmp_path, ["\n".join(names[i % 5 :] + names[: i % 5]) for i in range(21)])
    assert difference(QUERIES["persons_of_lines"](spark, folder), SQL["persons_of_lines"], folder) == ""


def test_soft_search_when_a_swap_spans_a_lost_or_new_letter(spark, tmp_path):
    folder = folder_of(tmp_path, ["etai mouday", "hxteai mouday", "theika mouday", "theai omxuday", "htxeai omxudya", "thaei muoday", "theai mouday", None, "etai"])
    assert difference(QUERIES["soft_search_alternatives"](spark, folder), SQL["soft_search_alternatives"], folder) == ""
