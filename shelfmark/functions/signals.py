"""Signal phrases and the evidence contract: fixed values that results depend on."""

from __future__ import annotations

from dataclasses import dataclass

SUPPLEMENT, FLAMMABLE = "БАД", "Легковоспламеняющиеся"


@dataclass(frozen=True)
class Signal:
    """Phrases that count, and phrases that void a match close by."""

    patterns: tuple[str, ...]
    excluded_by: tuple[str, ...] = ()


#: Characters between a match and an excluding phrase, up to which it is voided.
WINDOW = 80

# Patterns of a negation anywhere in a text.
NEGATIONS = (
    r'(?<!\w)не(?!\w)',
    r'(?<!\w)без(?!\w)',
    r'(?<!\w)отсутств\w*',
    r'(?<!\w)отдельно(?!\w)',
)

# Patterns of each category's signals, in the order in which they are reported.
SIGNALS: dict[str, dict[str, Signal]] = {
    SUPPLEMENT: {
        "explicit_bad_marker": Signal(
            (
                r'(?<!\w)б\.?\s*а\.?\s*д\.?(?!\w)',
                r'биологическ\w*\s+активн\w*\s+добавк\w*',
                r'биодобавк\w*',
            ),
            (
                r'не\s+(?:явля\w*|относ\w*|счита\w*)\s+(?:биологическ\w*\s+активн\w*\s+добавк\w*|б\.?\s*а\.?\s*д\.?)',
                r'не\s+(?:биологическ\w*\s+активн\w*\s+добавк\w*|б\.?\s*а\.?\s*д\.?)',
            ),
        ),
        "dietary_supplement_marker": Signal(
            (
                r'(?<!\w)dietary\s+supplements?(?!\w)',
                r'(?<!\w)food\s+supplements?(?!\w)',
            ),
            (
                r'(?:not|no)\s+(?:a\s+)?(?:dietary|food)\s+supplements?',
            ),
        ),
        "explicit_not_bad": Signal(
            (
                r'не\s+(?:явля\w*|относ\w*|счита\w*)\s+(?:биологическ\w*\s+активн\w*\s+добавк\w*|б\.?\s*а\.?\s*д\.?)',
                r'не\s+(?:биологическ\w*\s+активн\w*\s+добавк\w*|б\.?\s*а\.?\s*д\.?)',
                r'(?:not|no)\s+(?:a\s+)?(?:dietary|food)\s+supplements?',
            ),
        ),
        "sport_nutrition": Signal(
            (
                r'спортивн\w*\s+питан\w*',
                r'(?<!\w)(?:bcaa|бцаа)(?!\w)',
                r'(?<!\w)(?:l[\s-]?(?:карнитин|carnitine))(?!\w)',
                r'(?<!\w)аминокислот\w*',
                r'(?<!\w)(?:протеин\w*|protein)(?!\w)',
                r'(?<!\w)(?:гейнер\w*|creatine|креатин\w*)(?!\w)',
                r'(?<!\w)(?:предтрен\w*|pre[\s-]?workout)(?!\w)',
            ),
        ),
    },
    FLAMMABLE: {
        "independent_ignition_source": Signal(
            (
                r'(?<!\w)зажигалк\w*',
                r'(?<!\w)спичк\w*',
                r'(?<!\w)огнив\w*',
            ),
            (
                r'(?:чехл\w*|чехол\w*|футляр\w*|держател\w*|подставк\w*|наклейк\w*|кремн\w*|фитил\w*|запчаст\w*|ремкомплект\w*).{0,40}(?:зажигалк\w*|спичк\w*)',
                r'(?:спичечниц\w*|короб\w*\s+для\s+спич\w*)',
                r'без\s+(?:спичк\w*|зажигалк\w*)',
            ),
        ),
        "fuel_present": Signal(
            (
                r'жидкост\w*\s+для\s+(?:розжиг\w*|зажигал\w*)',
                r'(?:газ\w*\s+(?:баллон\w*|картридж\w*)|(?:баллон\w*|картридж\w*)\s+газ\w*)',
                r'(?:газ|бензин)\w*\s+для\s+зажигал\w*',
                r'(?:сух\w*\s+топлив\w*|топлив\w*\s+сух\w*)',
                r'(?<!\w)(?:биоэтанол\w*|керосин\w*)(?!\w)',
                r'(?:древесн\w*\s+угол\w*|угол\w*\s+древесн\w*)',
                r'угол\w*\s+для\s+(?:мангал\w*|грил\w*|кальян\w*)',
                r'(?:брик(?:ет|еты)\w*|палочк\w*)\s+для\s+розжиг\w*',
            ),
            (
                r'(?:фильтр\w*|картридж\w*)\s+(?:с|из)\s+активированн\w*\s+угл\w*',
                r'угол\w*\s+для\s+рисован\w*',
                r'(?:чехол\w*|сумк\w*|держател\w*|подогрев\w*|переходник\w*|редуктор\w*).{0,50}(?:баллон\w*|картридж\w*)',
                r'(?:баллон\w*|картридж\w*).{0,50}(?:чехол\w*|сумк\w*|держател\w*|подогрев\w*|переходник\w*|редуктор\w*)',
                r'(?:баллон\w*|картридж\w*).{0,20}пуст\w*',
            ),
        ),
        "fuel_included": Signal(
            (
                r'(?:баллон\w*|картридж\w*|газ\w*|топлив\w*|жидкост\w*).{0,45}(?:вход\w*|включ\w*|в\s+комплект\w*)',
                r'в\s+комплект\w*.{0,45}(?:баллон\w*|картридж\w*|газ\w*|топлив\w*|жидкост\w*)',
                r'заправлен\w*\s+(?:газ\w*|топлив\w*)',
            ),
            (
                r'(?:не\s+(?:вход\w*|включ\w*)|без\s+(?:баллон\w*|картридж\w*|газ\w*|топлив\w*))',
            ),
        ),
        "requires_external_fuel": Signal(
            (
                r'работ\w*.{0,30}(?:от|с)\s+(?:внешн\w*\s+)?(?:газов\w*\s+)?(?:баллон\w*|картридж\w*)',
                r'подключ\w*.{0,35}(?:баллон\w*|картридж\w*|газ\w*)',
                r'треб\w*.{0,35}(?:баллон\w*|картридж\w*|газ\w*|топлив\w*)',
                r'(?:баллон\w*|картридж\w*|газ\w*|топлив\w*).{0,35}(?:приобрета\w*|покупа\w*)\s+отдельно',
                r'под\s+(?:сменн\w*\s+)?(?:газов\w*\s+)?(?:баллон\w*|картридж\w*)',
            ),
        ),
        "flammable_item_in_kit": Signal(
            (
                r'в\s+комплект\w*.{0,55}(?:зажигалк\w*|спичк\w*|баллон\w*|картридж\w*|топлив\w*|жидкост\w*\s+для\s+розжиг\w*)',
                r'(?:зажигалк\w*|спичк\w*|баллон\w*|картридж\w*|топлив\w*).{0,45}(?:вход\w*|включ\w*)\s+в\s+комплект\w*',
            ),
            (
                r'не\s+(?:вход\w*|включ\w*)\s+в\s+комплект\w*',
            ),
        ),
        "flammable_item_not_in_kit": Signal(
            (
                r'(?:зажигалк\w*|спичк\w*|баллон\w*|картридж\w*|топлив\w*).{0,35}не\s+(?:вход\w*|включ\w*)\s+в\s+комплект\w*',
                r'в\s+комплект\w*.{0,35}не\s+(?:вход\w*|включ\w*).{0,35}(?:зажигалк\w*|спичк\w*|баллон\w*|картридж\w*|топлив\w*)',
                r'без\s+(?:спичк\w*|зажигалк\w*)',
            ),
        ),
        "explicit_without_fuel": Signal(
            (
                r'(?:баллон\w*|картридж\w*|газ\w*|топлив\w*|горюч\w*).{0,30}не\s+(?:вход\w*|включ\w*|поставля\w*)',
                r'(?:без|не\s+содерж\w*)\s+(?:газ\w*|топлив\w*|баллон\w*|картридж\w*|горюч\w*)',
                r'поставля\w*\s+без\s+(?:газ\w*|топлив\w*|баллон\w*|картридж\w*)',
                r'(?:баллон\w*|картридж\w*|газ\w*|топлив\w*).{0,35}(?:приобрета\w*|покупа\w*)\s+отдельно',
                r'(?:баллон\w*|картридж\w*|емкост\w*).{0,20}пуст\w*',
                r'пуст\w*.{0,20}(?:баллон\w*|картридж\w*|емкост\w*)',
            ),
        ),
        "device_with_embedded_ignition": Signal(
            (
                r'(?:пьезо|электро)[\s-]?поджиг\w*',
                r'встроенн\w*.{0,30}(?:поджиг\w*|источник\w*\s+зажиган\w*)',
            ),
        ),
        "flammable_component": Signal(
            (
                r'(?:фильтр\w*|картридж\w*).{0,45}активированн\w*\s+угл\w*',
                r'активированн\w*\s+угол\w*.{0,45}(?:фильтр\w*|картридж\w*)',
                r'угольн\w*.{0,20}(?:фильтр\w*|картридж\w*)',
                r'угол\w*\s+для\s+рисован\w*',
            ),
        ),
        "combustible_device": Signal(
            (
                r'(?<!\w)(?:мангал\w*|грил\w*|горелк\w*|камин\w*|печ\w*|обогревател\w*)(?!\w)',
                r'газов\w*\s+плит\w*',
            ),
        ),
    },
}

# Where evidence may come from, as (needs text, needs an image index).
SOURCES = {"name": (True, False), "description": (True, False), "ocr": (True, True), "image": (False, True)}
UNKNOWN = "unknown"
TRI_STATE = (True, False, UNKNOWN)

# The fields of each category with the values they may take, and its rules.
FIELDS: dict[str, dict[str, tuple]] = {
    SUPPLEMENT: {
        "explicit_bad_marker": TRI_STATE,
        "dietary_supplement_marker": TRI_STATE,
        "explicit_not_bad": TRI_STATE,
        "sport_nutrition": TRI_STATE,
        "marker_source": ("name", "description", "ocr", "image", UNKNOWN),
    },
    FLAMMABLE: {
        "object_type": (
            "independent_ignition_source",
            "combustible_content",
            "device_requiring_external_fuel",
            "device_with_embedded_ignition",
            "flammable_component",
            "kit",
            "other",
            UNKNOWN,
        ),
        "fuel_present": TRI_STATE,
        "fuel_included": TRI_STATE,
        "requires_external_fuel": TRI_STATE,
        "independent_ignition_source": TRI_STATE,
        "flammable_item_in_kit": TRI_STATE,
        "explicit_without_fuel": TRI_STATE,
    },
}
RULE_IDS: dict[str, tuple[str, ...]] = {
    SUPPLEMENT: ("EXPLICIT_BAD_MARKER", "DIETARY_SUPPLEMENT_MARKER", "EXPLICIT_NOT_BAD", "SPORT_NUTRITION", "NO_BAD_MARKER", "INSUFFICIENT_EVIDENCE"),
    FLAMMABLE: (
        "INDEPENDENT_IGNITION_SOURCE",
        "FLAMMABLE_CONTENT",
        "FLAMMABLE_ITEM_IN_KIT",
        "DEVICE_WITHOUT_INCLUDED_FUEL",
        "DEVICE_WITH_EMBEDDED_IGNITION",
        "FLAMMABLE_COMPONENT_ONLY",
        "NO_FLAMMABLE_CONTENT",
        "INSUFFICIENT_EVIDENCE",
    ),
}
UNDECIDED = "INSUFFICIENT_EVIDENCE"
