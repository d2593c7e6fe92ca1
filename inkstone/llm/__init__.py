"""Operations for preparing training text at scale.

Nothing outside this subpackage imports it; :mod:`inkstone.llm.queries` registers its operators.
"""
