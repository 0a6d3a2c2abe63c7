"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from .centroids import OP11_SQL, op11_kd_filter
from .lm import OP12_SQL, op12_backoff_automaton
from .minhash import OP10_SQL, op10_bayes_minhash
from .mixing import op2_pivotal
from .packing import op4_bin_slack
from .projections import OP1_SQL, op1_collision_counting
from .quality import OP7_SQL, op7_line_first
from .search import OP13_SQL, op13_max_trees
from .sharding import OP6_SQL, op6_rendezvous
from .sstable import op9_sstable
from .substrings import OP5_SQL, op5_super_kmers
from .url_filter import OP8_SQL, op8_blocked_bloom
from .warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_collision_counting": op1_collision_counting,
    "op2_pivotal": op2_pivotal,
    "op3_warc": op3_warc,
    "op4_bin_slack": op4_bin_slack,
    "op5_super_kmers": op5_super_kmers,
    "op6_rendezvous": op6_rendezvous,
    "op7_line_first": op7_line_first,
    "op8_blocked_bloom": op8_blocked_bloom,
    "op9_sstable": op9_sstable,
    "op10_bayes_minhash": op10_bayes_minhash,
    "op11_kd_filter": op11_kd_filter,
    "op12_backoff_automaton": op12_backoff_automaton,
    "op13_max_trees": op13_max_trees,
}

ORACLE_SQL = {
    "op1_collision_counting": OP1_SQL,
    "op3_warc": OP3_SQL,
    "op5_super_kmers": OP5_SQL,
    "op6_rendezvous": OP6_SQL,
    "op7_line_first": OP7_SQL,
    "op8_blocked_bloom": OP8_SQL,
    "op10_bayes_minhash": OP10_SQL,
    "op11_kd_filter": OP11_SQL,
    "op12_backoff_automaton": OP12_SQL,
    "op13_max_trees": OP13_SQL,
}
