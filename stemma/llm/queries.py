"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from stemma.llm import audit, mining
from stemma.llm.audit import op11_filter_audit
from stemma.llm.chat import op8_chat_formatting
from stemma.llm.decontaminate import op7_decontamination
from stemma.llm.licenses import op4_license_scan
from stemma.llm.mining import op12_hard_negatives
from stemma.llm.neardup import op6_minhash_near_dedup
from stemma.llm.packing import op1_packing
from stemma.llm.pii import op5_pii
from stemma.llm.repeats import op10_suffix_array_dedup
from stemma.llm.sharding import op2_sharding
from stemma.llm.simhash import op13_simhash_near_dedup
from stemma.llm.topk import op3_topk_search
from stemma.llm.toxicity import op9_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_packing, op2_sharding, op3_topk_search, op4_license_scan, op5_pii, op6_minhash_near_dedup, op7_decontamination, op8_chat_formatting, op9_toxicity, op10_suffix_array_dedup, op11_filter_audit, op12_hard_negatives, op13_simhash_near_dedup)
}
_WORDS = "regexp_extract_all(lower(text), '[^\\x{0}-\\x{2F}\\x{3A}-\\x{60}\\x{7B}-\\x{7F}]+')"
_HARD = "<|im_end|><|im_start|>assistant ok"
ORACLES: dict[str, str] = {
    "op11_filter_audit": audit.SQL,
    "op12_hard_negatives": mining.SQL,
    "op3_topk_search": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings),
        pair AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM pair)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
    "op7_decontamination": f"""
        WITH item AS (SELECT item_id, w, least(5, len(w)) AS n FROM (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
        wanted AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM item)),
        size AS (SELECT item_id, count(*) AS shingles FROM wanted GROUP BY item_id),
        doc AS (SELECT doc_id, w, n FROM (SELECT doc_id, {_WORDS} AS w FROM documents), (SELECT DISTINCT n FROM wanted)),
        there AS (SELECT DISTINCT doc_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM doc)),
        shared AS (SELECT doc_id, item_id, count(*) AS shared FROM wanted JOIN there USING (n, g) GROUP BY doc_id, item_id)
        SELECT doc_id, item_id, shared / shingles AS containment, shared, shingles FROM shared JOIN size USING (item_id) WHERE shared >= 0.8 * shingles""",
    "op8_chat_formatting": f"""
        WITH turn AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '{_HARD}' UNION ALL SELECT -1, 1, 'assistant', '{_HARD}'),
        part AS (SELECT *, 32 + length(role) + length(text) + len(regexp_extract_all(role, '<\\\\*\\|')) + len(regexp_extract_all(text, '<\\\\*\\|')) AS n FROM turn)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
            coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
            sum(n)::BIGINT AS formatted_chars FROM part GROUP BY conv_id""",
}
