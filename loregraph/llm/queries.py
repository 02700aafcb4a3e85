"""Queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from loregraph.llm.ann import op2_neighbours
from loregraph.llm.chat import op6_chat
from loregraph.llm.decontaminate import op3_decontamination
from loregraph.llm.licenses import op4_licenses
from loregraph.llm.merkle import OP12_SQL, op12_merkle
from loregraph.llm.minhash import OP1_SQL, OP11_SQL, op11_minhash
from loregraph.llm.mixing import op5_mixing
from loregraph.llm.ngram_join import op1_ngram_join
from loregraph.llm.quality import op9_quality
from loregraph.llm.sharding import op8_sharding
from loregraph.llm.suffix_dedup import op7_suffix_dedup
from loregraph.llm.substring import op10_substring
from loregraph.llm.vector_codes import OP13_SQL, op13_codes

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_neighbours": op2_neighbours,
    "op3_decontamination": op3_decontamination,
    "op4_licenses": op4_licenses,
    "op5_mixing": op5_mixing,
    "op6_chat": op6_chat,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_sharding": op8_sharding,
    "op9_quality": op9_quality,
    "op10_substring": op10_substring,
    "op11_minhash": op11_minhash,
    "op12_merkle": op12_merkle,
    "op13_codes": op13_codes,
    "pipeline": corpus_pipeline.run,
}

#: Windows by their text; a word goes if a repeated window starts at most 34 words before it.
OP10_SQL = r"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS MATERIALIZED (SELECT r, unnest(list_transform(range(1, len(w) - 33), lambda i: {'i': i, 'h': md5(array_to_string(w[i : i + 34], ' '))}), recursive := true) FROM w WHERE len(w) >= 35),
rep AS (SELECT r, i AS p, true AS starts FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM w),
gone AS (SELECT r, p, word, coalesce(max(starts) OVER (PARTITION BY r ORDER BY p ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), false) AS cut FROM words LEFT JOIN rep USING (r, p)),
left_ AS (SELECT r, count(*) FILTER (cut) AS n, string_agg(word, ' ' ORDER BY p) FILTER (NOT cut) AS kept FROM gone GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN left_ USING (r)"""

ORACLE_SQL: dict[str, str] = {"op1_ngram_join": OP1_SQL, "op10_substring": OP10_SQL, "op11_minhash": OP11_SQL, "op12_merkle": OP12_SQL, "op13_codes": OP13_SQL}
