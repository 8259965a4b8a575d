"""All queries of this folder; importing it registers them."""

from ionloom.llm import q_chat, q_decontam, q_frames, q_jaccard, q_langid, q_packing, q_pieces, q_resample, q_secrets, q_sharding, q_topk, q_toxicity, q_wordpiece  # noqa: F401
from ionloom.llm.base import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
