"""Queries of the subpackage and their DuckDB statements."""

from quillspark.llm import lookalike, markup, mixing, neighbours, outranking, packing


def queries():
    return {"p3_found": neighbours.p3_found, "p3_knn": neighbours.p3_knn, "p3_recall": neighbours.p3_recall, "p4_found": outranking.p4_found, "p4_ranking": outranking.p4_ranking, "p7_found": markup.p7_found, "p7_clean": markup.p7_clean, "p8_packed": packing.p8_packed, "p8_report": packing.p8_report, "p9_selection": mixing.p9_selection, "p9_shares": mixing.p9_shares, "p10_found": lookalike.p10_found, "p10_classes": lookalike.p10_classes}


def oracle_sql():
    return {"p3_found": neighbours.P3_SQL, "p3_knn": neighbours.P3_KNN_SQL, "p4_found": outranking.P4_SQL, "p4_ranking": outranking.P4_RANKING_SQL, "p10_found": lookalike.P10_SQL, "p10_classes": lookalike.P10_CLASSES_SQL}
