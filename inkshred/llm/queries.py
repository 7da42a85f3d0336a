"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .centroids import SQL12, op12
from .decontaminate import SQL10, op10
from .fim import SQL11, op11
from .langid import op1
from .mixing import op7
from .ngram_join import SQL8_LINKS, op8, op8_links
from .quality import op9
from .rules import SQL3, SQL3_ABLATIONS, op3, op3_ablations
from .secrets import op5
from .shards import op4
from .token_counts import op13
from .toxicity import op6
from .url_rules import op2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1,
    "op2_url_association_rules": op2,
    "op3_quality_rules": op3,
    "quality_rule_ablations": op3_ablations,
    "op4_two_pass_shuffle": op4,
    "op5_randomness_battery": op5,
    "op6_levenshtein_toxicity": op6,
    "op7_pareto_mixing": op7,
    "op8_ngram_jaccard_join": op8,
    "ngram_jaccard_link_counts": op8_links,
    "op9_hierarchical_bayes_quality": op9,
    "op10_decontamination": op10,
    "op11_fill_in_middle": op11,
    "op12_exponion_clusters": op12,
    "op13_token_counts": op13,
}
SQL: dict[str, str] = {
    "op3_quality_rules": SQL3,
    "quality_rule_ablations": SQL3_ABLATIONS,
    "ngram_jaccard_link_counts": SQL8_LINKS,
    "op10_decontamination": SQL10,
    "op11_fill_in_middle": SQL11,
    "op12_exponion_clusters": SQL12,
}
