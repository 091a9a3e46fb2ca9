"""The modules whose QUERIES and SQL __spark_entry__ adds."""

from colsieve.llm import bpe, chat, digests, languages, merkle, minhash, mixing, near_copies, passages, periods, sharding, top_k, toxicity

MODULES = (sharding, chat, passages, languages, bpe, toxicity, top_k, mixing, digests, near_copies, minhash, merkle, periods)
