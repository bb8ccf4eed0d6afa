"""Operations for preparing training data: ten operators, one module each.

Nothing outside this subpackage imports it.  ``queries.py`` holds the thin
``opN_*`` queries and ``oracles.py`` the DuckDB SQL that checks them.
"""
