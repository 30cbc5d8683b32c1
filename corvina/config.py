"""Configuration: a JSON file over defaults. A missing file is created with the defaults, missing keys are filled in."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import asdict, dataclass, field, fields
from pathlib import Path

#: Order in which components run, whatever the order in the configuration.
COMPONENTS = ("normalize", "tokenize", "remove_stopwords", "lemmatize", "stop_words_cleaner", "document_saver")

#: Keys of older files, and what they are called here.
OLD_KEYS = {"inverted_index_path": "index_path", "sk_wikipedia_dump_path": "dump_path"}


@dataclass
class Config:
    index_path: str = "data/index"
    dump_path: str = "data/dump.xml"
    stop_words_path: str = "data/stopwords.txt"
    already_processed_path: str = "data/already_parsed"
    lemmas_path: str | None = None
    #: Whether words that the dictionary doesn't list are lemmatised by the endings of those that it lists.
    guess_lemmas: bool = False
    preprocessor_components: list[str] = field(default_factory=lambda: list(COMPONENTS))
    workers: int = 4
    verbose: bool = True
    #: What a raw token in a field counts.
    boosts: dict[str, float] = field(default_factory=lambda: {"title": 5.0, "infobox_name": 3.5, "infobox_key": 2.5, "infobox_value": 1.5})
    spark: dict[str, str] = field(default_factory=dict)


def load_config(path: str) -> Config:
    """Read ``path``; older names of keys are understood, unknown keys are ignored with a warning."""
    file = Path(path)
    if not file.exists():
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(json.dumps(asdict(Config()), indent=2, ensure_ascii=False))
    given = {OLD_KEYS.get(k, k): v for k, v in json.loads(file.read_text()).items()}
    known = {f.name for f in fields(Config)}
    for key in given.keys() - known:
        logging.warning("configuration key %s isn't known", key)
    return Config(**{k: v for k, v in given.items() if k in known})


def require_file(path: str | None) -> str:
    """The path, if it is given and there."""
    if path is None:
        raise ValueError("no path is given")
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    return path


def setup_logging(verbose: bool = True) -> None:
    logging.basicConfig(format="%(asctime)s %(levelname)s %(message)s", force=True, level=logging.INFO if verbose else logging.CRITICAL)
