"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from . import chat, jaccard, merkle, prefix_trie

ORACLES: dict[str, str] = {
    "op2_jaccard": jaccard.ORACLE,
    "op10_chat": chat.ORACLE,
    "op11_merkle": merkle.ORACLE,
    "op13_prefix_trie": prefix_trie.ORACLE,
}
