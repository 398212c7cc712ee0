"""Other names that a character goes by in one request: a Korean given name, and a Hangul word that spells a Latin name.

Spellings meet through a blocking key: a Latin name, and every way in which a Hangul word may be written in Latin letters, are
folded by an ordered list of rewrites, and what folds to the same key is the same name.  So texts meet names by equality of
keys, and no word is held against every name of its chat.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import name_key
from .entities import romanized

# One-syllable family names that a full name of three syllables may begin with.
FAMILY = "김이박최정강조윤장임한오서신권황안송류전홍고문양손배백허유남심노하곽성차주우구민진나지엄채원천방공현함변염여추도소석선설"
# Family names as they are usually written in Latin letters.
SPELLINGS = {
    "이": ("lee", "yi", "rhee", "i"), "박": ("park", "bak"), "김": ("kim", "gim"), "최": ("choi", "choe"), "정": ("jung", "jeong", "chung"), "강": ("kang", "gang"),
    "조": ("cho", "jo"), "윤": ("yoon", "yun"), "장": ("jang", "chang"), "임": ("lim", "im"), "오": ("oh", "o"), "서": ("seo", "suh"), "신": ("shin", "sin"),
    "권": ("kwon", "gwon"), "안": ("ahn", "an"), "류": ("ryu", "yoo", "yu"), "유": ("yoo", "yu"), "전": ("jeon", "jun", "chun"), "고": ("ko", "go"), "문": ("moon", "mun"),
    "손": ("son", "sohn"), "백": ("baek", "paik"), "허": ("heo", "huh"), "심": ("shim", "sim"), "노": ("noh", "no", "roh"), "곽": ("kwak", "gwak"), "성": ("sung", "seong"),
    "주": ("joo", "ju"), "우": ("woo", "u"), "구": ("koo", "gu", "ku"), "나": ("na", "ra"), "엄": ("eom", "um"), "천": ("cheon", "chun"), "현": ("hyun", "hyeon"),
}
# Rewrites that fold spellings together, in this order; a key of fewer letters says too little.
FOLDS = (
    ("oo", "u"), ("ou", "u"), ("eo", "u"), ("wu", "u"), ("ee", "i"), ("ui", "i"), ("yi", "i"), ("wo", "u"), ("ae", "e"), ("ai", "e"), ("sh", "s"), ("ch", "j"),
    ("k", "g"), ("p", "b"), ("t", "d"), ("l", "r"), ("rr", "r"), ("eu", "u"),
)
KEY_MIN = 4
#: Syllables of a Hangul word that may spell a name; a particle may follow it.
SIZES = (4, 3, 2)


def folded(latin: str) -> str:
    out = "".join(c for c in latin.lower() if "a" <= c <= "z")
    for written, key in FOLDS:
        out = out.replace(written, key)
    return out


def word_keys(word: str) -> list[str]:
    """Keys that a Hangul word may be spelled by: as it sounds, and with its family name as that is usually written."""
    ways = [romanized(word)]
    if len(word) > 2:
        ways += [usual + romanized(word[1:]) for usual in SPELLINGS.get(word[0], ())]
    return sorted({folded(w) for w in ways})


def name_keys(name: str) -> list[str]:
    """Keys of a Latin name in its normal form: all of it, and its last part if it has two."""
    if not re.fullmatch("[a-z][a-z' -]*", name):
        return []
    parts = name.split()
    return sorted({k for k in map(folded, [name, *parts[1:]] if len(parts) == 2 else [name]) if len(k) >= KEY_MIN})


@F.pandas_udf(T.ArrayType(T.StringType()))
def _word_keys(words: pd.Series) -> pd.Series:
    return words.map(word_keys)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _name_keys(names: pd.Series) -> pd.Series:
    return names.map(name_keys)


def _given(name: Column) -> Column:
    """The given name of a full Korean name, or null."""
    return F.when(name.rlike(f"^[{FAMILY}][가-힣]{{2}}$"), F.substring(name, 2, 2))


def variants(requests: DataFrame, entities: DataFrame) -> DataFrame:
    """(request_id, entity_id, variant): names in normal form that a character goes by in a request beside its own.

    requests: request_id, conv_id, text (the message and the reply before it), persona_names, marked (arrays of names; a marked
    name that no entity has is a character of its own, with the id ``mark:`` and the name).  entities: conv_id, entity_id, type,
    name (a row for each name), persona.

    A variant counts for one character only: not if two characters would share it, by whatever rule, and not if it is another
    entity's name, a name of the persona's, or the given name of one.  The persona gains none.
    """
    asked = requests.select("request_id", "conv_id")
    own = asked.join(entities.select("conv_id", F.col("entity_id").cast("string").alias("entity_id"), "type", name_key("name").alias("name"), F.coalesce("persona", F.lit(False)).alias("persona")), "conv_id").drop("conv_id")
    personas = requests.select("request_id", F.explode("persona_names").alias("n")).select("request_id", name_key("n").alias("name")).distinct()
    marks = requests.select("request_id", F.explode("marked").alias("n")).filter("n <> ''").select("request_id", name_key("n").alias("name")).distinct()
    marks = marks.join(own.select("request_id", "name"), ["request_id", "name"], "left_anti").join(personas, ["request_id", "name"], "left_anti")
    own = own.unionByName(marks.select("request_id", F.concat(F.lit("mark:"), "name").alias("entity_id"), F.lit("character").alias("type"), "name", F.lit(False).alias("persona")))
    characters = own.filter("type = 'character' AND NOT persona").select("request_id", "entity_id", "name").distinct()

    given = characters.select("request_id", "entity_id", _given(F.col("name")).alias("variant")).filter("variant IS NOT NULL")
    runs = requests.select("request_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[가-힣]+"), 0))).alias("run"))
    words = runs.withColumn("size", F.explode(F.array(*map(F.lit, SIZES)))).filter(F.length("run") >= F.col("size")).withColumn("variant", F.expr("substring(run, 1, size)"))
    spelled = words.select("variant").distinct().withColumn("key", F.explode(_word_keys("variant")))
    latin = characters.select("name").distinct().withColumn("key", F.explode(_name_keys("name")))
    said = words.join(spelled, "variant").join(characters.join(latin, "name"), ["request_id", "key"]).select("request_id", "run", "size", "variant", "entity_id")
    longest = Window.partitionBy("request_id", "run")
    said = said.withColumn("_most", F.max("size").over(longest)).filter("size = _most").select("request_id", "entity_id", "variant")

    owners = given.unionByName(said).distinct()
    alone = owners.groupBy("request_id", "variant").agg(F.min("entity_id").alias("entity_id"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    taken = own.select("request_id", "name").unionByName(personas).unionByName(personas.select("request_id", _given(F.col("name")).alias("name")).filter("name IS NOT NULL"))
    return alone.join(taken.select("request_id", F.col("name").alias("variant")), ["request_id", "variant"], "left_anti").select("request_id", "entity_id", "variant")
