"""Questions to models, as columns (``correction`` as text): data goes in as JSON, the form of the answer is stated last."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def filter_tags(title: Column, blurbs: Column, reviews: Column, tags: Column) -> Column:
    """Which of a book's tags say something about its content."""
    return _parts(
        "Keep the tags that describe the content of the book; remove the others and say why.\nTitle: ", _text(title), "\nBlurbs: ", _text(blurbs), "\nReviews: ", _text(reviews),
        "\nTags: ", F.to_json(tags), '\nUse only tags of this list, each once. Answer with JSON: {"keep": [...], "remove": [{"tag": "...", "reason": "..."}]}',
    )


def annotate(title: Column, tags: Column, genre_paths: Column, metadata_paths: Column) -> Column:
    """Which paths of two lists the tags support."""
    return _parts(
        "Choose the paths that the tags support, from the lists only.\nTitle: ", _text(title), "\nTags: ", F.to_json(tags), "\nGenre paths: ", F.to_json(genre_paths),
        "\nMetadata paths: ", F.to_json(metadata_paths), '\nAnswer with JSON: {"genre_paths": [...], "metadata_paths": [...]}',
    )


def resolve(title: Column, tags: Column, genre_paths: Column, metadata_paths: Column, annotations: Column) -> Column:
    """Annotators disagree on a book: which paths hold after weighing what each chose."""
    return _parts(
        "Annotators disagree about this book. Weigh their choices against the tags and decide which paths hold, from the lists only.\nTitle: ", _text(title), "\nTags: ", F.to_json(tags),
        "\nChoices: ", _text(annotations), "\nGenre paths: ", F.to_json(genre_paths), "\nMetadata paths: ", F.to_json(metadata_paths),
        '\nAnswer with JSON: {"genre_paths": [...], "metadata_paths": [...]}',
    )


_FORM = '"evidence_tags": [...], "justification": "..."}. Evidence tags are copied exactly from the list.'


def round1(path: Column, tags: Column, others: Column) -> Column:
    """A supporter of a disputed path is asked to maintain or retract it."""
    return _parts(
        "You chose a path that other annotators did not choose. Reconsider it by the tags alone.\nPath: ", path, "\nTags: ", F.to_json(tags), "\nOthers chose: ", F.to_json(others),
        '\nAnswer with JSON: {"decision": "MAINTAIN" or "RETRACT", ' + _FORM,
    )


def round2(path: Column, tags: Column, arguments: Column) -> Column:
    """An opponent is asked to accept or reject a path that its supporters maintain."""
    return _parts(
        "Other annotators maintain a path that you did not choose. Judge their arguments by the tags alone.\nPath: ", path, "\nTags: ", F.to_json(tags), "\nArguments: ", F.to_json(arguments),
        '\nAnswer with JSON: {"decision": "ACCEPT" or "REJECT", ' + _FORM,
    )


def correction(prompt: str, error: str) -> str:
    """The question again, with what was wrong with the last answer."""
    return f"{prompt}\n\nYour last answer was not valid: {error}\nAnswer again with the JSON object alone. Copy evidence tags exactly from the list; if none supports the path, leave the list empty."
