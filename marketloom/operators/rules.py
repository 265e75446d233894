"""The default rule set of the classifier: patterns as data, in the order they are tried.

All of this is fixed values: the classifier's results depend on these patterns, words and codes.
Another rule set is another :class:`RuleSet`.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: (reason, scope, pattern); scope: title, full, or both (title first).
NEGATIVE = [
    (
        "NEGATIVE_PARTS_TITLE", "title",
        r"^(?:продам\s+|продаю\s+|продаж\s+|продається\s+)?"
        r"(?:оригинальн\w+\s+|оригінальн\w+\s+|нов\w+\s+|б[/-]?у\s+)?"
        r"(?:запчаст\w*|запчастин\w*|детал\w*|фар[аыие]|фонар\w*|ліхтар\w*|капот\w*|крыл\w+|крил\w+|бампер\w*|"
        r"двигател\w*|мотор\w*|двигун\w*|кпп|акпп|мкпп|коробк\w+\s+передач|"
        r"турбин\w*|турбін\w*|тнвд|форсунк\w*|диск\w*|титан\w*|салон\w*|сидень\w*|сидінн\w*|"
        r"руль|керм\w*|приборк\w*|щиток\s+приборов|подлокотник\w*|радиатор\w*|радіатор\w*)"
        r"\b.{0,45}?\b(?:audi|ауд[иі]|[aа]6|[cс]5|passat)\b",
    ),
    (
        "NEGATIVE_BUYER_INQUIRY", "both",
        r"^(?:куплю|шукаю|придбаю|купим|ищу)\b|"
        r"\b(?:куплю|шукаю|придбаю|купим|ищу)\s+(?:audi|ауд[иі]|[aа]6|[cс]5|авто|машину|документ\w*|кузов)\b",
    ),
    (
        "NEGATIVE_TRADE_IN_TARGET", "full",
        r"\b(?:обмен\w*|обмін\w*|поменя\w*|помін\w*|розглян\w+\s+обмін|рассмотр\w+\s+обмен|цікавит\w+\s+обмін|интересу\w+\s+обмен)"
        r"\b.{1,50}?\bна\s+(?:авто\w*\s+|машин\w*\s+)?(?:audi|ауд[иі]|[aа]6|[cс]5)\b",
    ),
    (
        "NEGATIVE_DISMANTLING", "full",
        r"\b(?:разборк[аиуеы]|розбірк[аиуе]|розборк[аиуе]|авторазборк\w*|авторозбірк\w*|шрот|автошрот|"
        r"на\s+запчаст[иі]|по\s+запчаст(?:ям|ях|инах)|в\s+разбор|под\s+разбор|на\s+розборку|донор[ауе]?|на\s+донора|под\s+донора|"
        r"без\s+двигател[яей]|без\s+мотор[а]|без\s+двигун[а]|без\s+кпп|"
        r"кузов\s+с\s+документами|голый\s+кузов|техпаспорт\s+отдельно|только\s+кузов|разбира(?:ю|ется|ем)|розбира(?:ю|ється|ємо))\b",
    ),
    (
        "NEGATIVE_COMMERCIAL_SERVICE", "full",
        r"\b(?:пригон\s+(?:авто|под\s+заказ|з\s+європи|из\s+европы)|автоподбор|підбір\s+авто|"
        r"растаможк\w*|розмитненн\w*|помощь\s+в\s+растаможке|аренда\s+авто|авто\s+под\s+выкуп|оренда\s+авто|під\s+викуп|такси)\b",
    ),
]

BRANDS = ["audi", "ауди", "ауді"]
TARGET_MODELS = ["A6", "А6"]
KNOWN_MODELS = ["A6", "А6", "ALLROAD", "UNKNOWN"]
WRONG_STRUCTURED = [("WRONG_MODEL_A4", ["A4", "А4"]), ("WRONG_MODEL_A8", ["A8", "А8"])]

MODEL_A6 = r"\b(?:audi\s*)?[aа]6\b|\bауд[иі]\s*а6\b"
MODEL_A4 = r"\b(?:audi\s*)?[aа]4\b|\ba4\b|\bа4\b"
MODEL_A8 = r"\b(?:audi\s*)?[aа]8\b|\ba8\b|\bа8\b"
MODEL_OTHER = r"\b(?:audi\s*)?(?:[aа][12357]|q[3578]|tt|80|100|s4|s8|rs4)\b"
OTHER_MAKE_TITLE = r"^(?:bmw|passat|volkswagen|vw|mercedes|opel|skoda|ford|renault|peugeot)\b"
GENERATION_C5 = r"\b(?:[cс]5|4[bв]|горбат\w*|капл\w*|черепах\w*|черепас\w*)\b"
OTHER_GENERATIONS = [
    ("GENERATION_C4", r"\b(?:[cс]4|4[aа]|typ\s*4a)\b"),
    ("GENERATION_C6", r"\b(?:[cс]6|4[fф]|typ\s*4f)\b"),
    ("GENERATION_C7", r"\b(?:[cс]7|typ\s*4g)\b"),
    ("GENERATION_C8", r"\b(?:[cс]8|typ\s*4k)\b"),
]
BODY_AVANT = r"\b(?:avant|авант|универсал|універсал|комби|station\s*wagon|wagon)\b"
BODY_SEDAN = r"\b(?:sedan|седан|лимузин)\b"
AVANT_WORDS = ["avant", "универсал", "універсал", "wagon"]
SEDAN_WORDS = ["sedan", "седан"]
YEAR = r"\b(199\d|200\d|201\d|202\d)\b"

REJECTED_ENGINES = [
    ("REJECTED_ENGINE_2.5_TDI", r"\b2\.5\s*(?:tdi|тди|тді|дизель|diesel|v6)?\b"),
    ("REJECTED_ENGINE_2.7T", r"\b2\.7\s*(?:[tт]|biturbo|битурбо|turbo|турбо)\b"),
    ("REJECTED_ENGINE_2.8", r"\b2\.8(?!\d)\b"),
    ("REJECTED_ENGINE_3.0", r"\b3\.0(?!\d)\b"),
    ("REJECTED_ENGINE_4.2", r"\b4\.2(?!\d)\b|\bs6\b|\brs6\b"),
    ("REJECTED_ENGINE_2.0", r"\b2\.0(?!\d)(?:\s*(?:alt|бензин|бенз))?\b"),
    (
        "REJECTED_ENGINE_1.8_NON_TURBO",
        r"\b1\.8\b.{0,35}?\b(?:125\s*(?:л\.?с|квт|hp)|92\s*(?:квт|kw)|атмосфер\w*|(?:без|не)\s+(?:турб\w+|turbo)|простой|простий|adr|agn|afy)\b|"
        r"\b(?:125\s*(?:л\.?с|квт|hp)|92\s*(?:квт|kw)|атмосфер\w*|(?:без|не)\s+(?:турб\w+|turbo)|простой|простий|adr|agn|afy)\b.{0,35}?\b1\.8\b",
    ),
    ("REJECTED_ENGINE_OTHER", r"\b(?:1\.6|2\.6|3\.2(?:\s*fsi)?)\b"),
]
#: (engine, pattern in the text, substring of the structured engine, words one of which must stand with it)
TARGET_ENGINES = [
    (
        "1.8T",
        r"\b1\.8\s*(?:[tт]|(?<!\bбез\s)(?<!\bне\s)(?:turbo|турбо|турбіна|турбован\w*|турбирован\w*)|150\s*(?:л\.?с|квт|кw|hp)|180\s*(?:л\.?с|квт|кw|hp))\b|"
        r"\b1\.8\b.{0,25}?\b(?<!\bбез\s)(?<!\bне\s)(?:turbo|турбо|турбін\w*|турбован\w*|турбирован\w*|150\s*л|180\s*л|110\s*к|132\s*к)\b|"
        r"\b(?:aeb|ajl|apu|ark|anb|awt)\b",
        "1.8", ["t", "турбо"],
    ),
    (
        "2.4",
        r"\b2\.4(?!\d)(?:\s*(?:v6|бензин|газ|гбо|газ[/-]бензин|газ\s*бензин))?\b|\b(?:aga|alf|aps|arj|aml|ajg|apz|amm|bdv|alw|arn|asm)\b",
        "2.4", [],
    ),
    (
        "1.9_TDI",
        r"\b1\.9\s*(?:tdi|тди|тді|дизель|diesel|насос[ -]форсунк[аи]|pd)\b|"
        r"\b1\.9(?!\d)(?:\s*(?:81\s*(?:квт|kw)|96\s*(?:квт|kw)|130\s*(?:л\.?с|hp)|110\s*(?:л\.?с|hp)|115\s*(?:л\.?с|hp)))?\b|\b(?:afn|avg|ajm|avf|awx)\b",
        "1.9", [],
    ),
]
GENERIC_18 = r"\b1\.8(?!\d)\b"


@dataclass(frozen=True)
class RuleSet:
    """Everything the ladder asks of a text, and the years it accepts."""

    negative: list = field(default_factory=lambda: NEGATIVE)
    brands: list = field(default_factory=lambda: BRANDS)
    rejected_engines: list = field(default_factory=lambda: REJECTED_ENGINES)
    target_engines: list = field(default_factory=lambda: TARGET_ENGINES)
    other_generations: list = field(default_factory=lambda: OTHER_GENERATIONS)
    label: str = "AUDI_A6_C5"
    generation: str = "C5"
    first_year: int = 1997
    last_year: int = 2005
