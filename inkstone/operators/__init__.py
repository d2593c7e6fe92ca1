from inkstone.operators.statements import distinct_statements, fingerprint_counts, token_rows, with_normalized, with_obfuscated, with_tokens

__all__ = ["distinct_statements", "fingerprint_counts", "token_rows", "with_normalized", "with_obfuscated", "with_tokens"]
