"""Registered queries of the engine's own operators, by section, each with the DuckDB SQL that says what it returns."""
