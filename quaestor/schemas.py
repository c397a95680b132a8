"""Closed schemas of the evidence model; readers use them and infer nothing."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "strings": T.ArrayType(T.StringType()), "floats": T.ArrayType(T.FloatType())}


def _schema(fields: str) -> T.StructType:
    """`name kind` parts, with `!` after a kind that can't be null; needs no session."""
    parts = [f.split() for f in fields.split(", ")]
    return T.StructType([T.StructField(name, _KINDS[kind.rstrip("!")], not kind.endswith("!")) for name, kind in parts])


SECTION = _schema("ticker string!, fiscal_year int!, item string!, texto string!, cik long, empresa string, n_tokens int, item_origen string, url_origen string")
CHUNK = _schema("chunk_id string!, ticker string!, fiscal_year int!, item string!, posicion int!, texto string!, n_tokens int!, contiene_tabla boolean!, inicio_car int!, fin_car int!")
FACT = _schema("ticker string, fiscal_year int, concept string, value double, unit string, period_end string, form string")
VECTOR = _schema("id string!, vector floats!")
CASE = _schema(
    "id string!, pregunta string!, familia string!, ticker string!, fiscal_year int!, respuesta_esperada string!, cifra_esperada double, unidad string, concept_xbrl string, "
    "item_esperado string, ancla_texto string, ancla_inicio int, ancla_fin int, chunk_id_esperado string, herramienta_esperada strings, autor string, respuesta_en_corpus boolean, fuente_esperada string"
)
RESULT = _schema("id string, familia string, ticker string, latencia_s double, coste_usd double, llamadas int, cita boolean, cifra boolean, trayectoria boolean, recall double, acierto boolean, error string")
#: Names that a case can't do without.
CASE_REQUIRED = ("id", "pregunta", "familia", "ticker", "fiscal_year", "respuesta_esperada")
