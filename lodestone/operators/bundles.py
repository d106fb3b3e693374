"""Scored documents, repository bundles, and small operations on nested rows and tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.numbers import int_score
from lodestone.functions.text import END_OF_TEXT


def scored_documents(docs: DataFrame, score: Column, least: int = 2, text: str = "text") -> DataFrame:
    """text, length, score and int_score of the documents whose rounded score is at least `least`."""
    return docs.select(F.col(text).alias("text"), F.length(text).alias("length"), score.alias("score")).withColumn("int_score", int_score(F.col("score"))).where(F.col("int_score") >= least)


def bundles(files: DataFrame, repo: str = "repo_name", order: str = "path", text: str = "text", mark: str = END_OF_TEXT) -> DataFrame:
    """repo_name and text: the files of each repository, in order of their paths, each followed by the marker. Repositories without files give nothing."""
    ordered = F.array_sort(F.collect_list(F.struct(order, text)))
    return files.where(F.col(text).isNotNull()).groupBy(repo).agg(ordered.alias("f")).select(repo, F.array_join(F.transform("f", lambda x: F.concat(x[text], F.lit(mark))), "").alias("text"))


def bundle_files(text: Column, mark: str = END_OF_TEXT) -> Column:
    """The files of a bundle; what follows the last marker isn't one."""
    parts = F.split(text, r"\Q" + mark + r"\E", -1)
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def filtered_bundle(text: Column, scores: Column, above: int = 2, mark: str = END_OF_TEXT) -> Column:
    """Struct text, results and length of a bundle's files whose int_score exceeds `above`, each followed by the marker; `scores` has a number for each file."""
    both = F.zip_with(bundle_files(text, mark), scores, lambda p, s: F.struct(p.alias("p"), s.alias("score"), int_score(s).alias("int_score")))
    kept = F.filter(both, lambda x: x["p"].isNotNull() & (x["int_score"] > above))
    joined = F.array_join(F.transform(kept, lambda x: F.concat(x["p"], F.lit(mark))), "")
    return F.struct(joined.alias("text"), F.transform(kept, lambda x: F.struct(x["score"], x["int_score"])).alias("results"), F.length(joined).alias("length"))


def lifted(df: DataFrame, column: str) -> DataFrame:
    """The fields of a struct column as the columns; rows where it is null are left out."""
    return df.where(F.col(column).isNotNull()).select(f"{column}.*")


def flattened(df: DataFrame, between: str = ".") -> DataFrame:
    """Structs, at any depth, as columns with joined names."""

    def walk(kind: T.StructType, path: tuple[str, ...]) -> list[Column]:
        out = []
        for f in kind.fields:
            here = (*path, f.name)
            out += walk(f.dataType, here) if isinstance(f.dataType, T.StructType) else [F.col(".".join(f"`{p}`" for p in here)).alias(between.join(here))]
        return out

    return df.select(*walk(df.schema, ()))


def byte_lengths(stream: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """A stream with n_bytes, the length of each token; the vocabulary (id, bytes) is broadcast, a row an id."""
    sizes = vocabulary.select(F.col("id").alias(token), F.octet_length("bytes").alias("n_bytes"))
    return stream.join(F.broadcast(sizes), token)


def chosen_tasks(tasks: DataFrame, labels: list[str]) -> DataFrame:
    """Tasks by label; an error names those that aren't there."""
    unknown = set(labels) - {r["label"] for r in tasks.where(F.col("label").isin(labels)).select("label").distinct().collect()}
    if unknown:
        raise ValueError(f"unknown tasks: {', '.join(sorted(unknown))}")
    return tasks.where(F.col("label").isin(labels))


def simple_prompt(prompt: Column, chat: bool) -> Column:
    """A prompt after the beginning mark, as a user's turn if it is a chat."""
    if not chat:
        return F.concat(F.lit("<|bos|>"), prompt)
    return F.concat(F.lit("<|bos|><|user_start|>"), prompt, F.lit("<|user_end|><|assistant_start|>"))


# Endings that are parts of their own after an apostrophe.
ENDINGS = ("s", "d", "m", "t", "ll", "ve", "re")


def phrase_parts(text: Column) -> Column:
    """Pieces for merges across words. A text is cut in four places, from which the pattern is put together:

    before an apostrophe with an ending that follows a letter, after such an ending if the word ends there (so that
    "it's" gives 's but "o'steam" stays whole), between - and |, and within digits wherever groups of three are left.
    """
    ending = f"['’](?i:{'|'.join(ENDINGS)})" + r"\b"
    cuts = [rf"(?<=\p{{L}})(?={ending})", f"(?<={ending})"]
    cuts += [rf"(?<={a})(?={b})" for a, b in (("-", r"\|"), (r"\|", "-"))]
    cuts.append(r"(?<=\d)(?=(?:\d{3})+(?!\d))")
    return F.filter(F.split(text, "|".join(cuts), -1), lambda p: p != "")


def with_field(df: DataFrame, dotted: str, value: Column) -> DataFrame:
    """df with a field, at any depth, set by its dotted name; an error if there is no such field."""
    column, *path = dotted.split(".")
    kind = df.schema[column].dataType
    for p in path:
        if not isinstance(kind, T.StructType) or p not in kind.names:
            raise KeyError(dotted)
        kind = kind[p].dataType
    return df.withColumn(column, F.col(column).withField(".".join(path), value) if path else value)


def rendered(template: str, fields: dict[str, Column]) -> Column:
    """A template with {dotted.name} replaced by the fields; an error names one that isn't there."""
    import string

    parts: list[Column] = []
    for said, name, _, _ in string.Formatter().parse(template):
        parts.append(F.lit(said))
        if name is not None:
            if name not in fields:
                raise KeyError(name)
            parts.append(fields[name].cast("string"))
    return F.concat(*parts)


def with_extension(paths: Column, extensions: tuple[str, ...]) -> Column:
    """Whether any of a repository's files has one of the extensions (with their dots)."""
    found = F.transform(paths, lambda p: F.regexp_extract(p, r"(\.[^./]+)$", 1))
    return F.arrays_overlap(found, F.array(*[F.lit(e) for e in extensions]))
