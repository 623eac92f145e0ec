"""Rules of traits: what a value may describe, what a trait's evidence must be, and the shape of visual references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.udfs import fold, plain
from .timeline import PRESENCE

# Fixed values, over folded text without accents: cues of body parts.
BODY_CUES = {
    "hair": r"\b(?:cheveux?|chevelure|hair)\b",
    "eyes": r"\b(?:yeux|oeil|eyes?|iris|regard|gaze)\b",
    "lips": r"\b(?:levres?|lips?)\b",
    "cheekbones": r"\b(?:pommettes?|cheekbones?)\b",
    "teeth": r"\b(?:dents?|teeth|tooth)\b",
    "neck": r"\b(?:cou|neck|adam)\b",
    "legs": r"\b(?:jambes?|legs?)\b",
    "arms": r"\b(?:bras|arms?)\b",
    "feet": r"\b(?:pieds?|feet|foot)\b",
    "shoulders": r"\b(?:epaules?|shoulders?)\b",
    "build": r"\b(?:build|physique|elance\w*|slender|slim|degingande\w*|lanky|corpulent\w*|musculeu\w*|muscular|charpente\w*|silhouette)\b",
    "facial_hair": r"\b(?:barbe|barbu\w*|moustache|mustache|beard\w*|stubble|facial hair|clean.shaven|glabre|rase)\b",
    "face": r"\b(?:visage|face|facial)\b",
    "jowls": r"\b(?:bajoues?|jowls?)\b",
    "chin": r"\b(?:mentons?|chins?)\b",
    "belly": r"\b(?:panse|ventre|bedaine|belly|paunch|abdomen)\b",
}
# The traits that each body part may support.
BODY_TRAITS = {
    "hair": ["hair_color", "hair_length", "hair_texture", "hair_thickness", "hair_style"],
    "eyes": ["eye_color", "eye_size", "eye_shape", "eye_appearance"],
    "lips": ["lips"],
    "cheekbones": ["cheekbones"],
    "teeth": ["teeth"],
    "neck": ["neck", "adams_apple"],
    "legs": ["leg_shape", "body_hair", "skin_color", "injury"],
    "arms": ["arm_build", "body_hair", "skin_color", "injury"],
    "feet": ["foot_size"],
    "shoulders": ["shoulder_width", "build"],
    "build": ["build"],
    "facial_hair": ["facial_hair"],
    "face": ["face_shape", "skin_color", "skin_texture", "cheekbones", "lips", "chin", "nose_shape", "eye_color", "eye_size", "eye_shape", "eye_appearance", "teeth", "distinguishing_mark", "injury"],
    "jowls": ["face_shape"],
    "chin": ["chin"],
    "belly": ["build"],
}
# Fixed value: colours.
COLORS = r"\b(?:noir\w*|blanc\w*|brun\w*|roux|rousse|blond\w*|bleu\w*|vert\w*|gris\w*|noisette|sombre\w*|black|white|brown|red|auburn|blond\w*|blue|green|grey|gray|hazel|dark|raven|corbeau)\b"
# Fixed value: qualities that take the part that their quotation names.
QUALITIES = r"(?:epais\w*|thick\w*|thin|fin[es]*|plein\w*|full|long\w*|court\w*|short|boucle\w*|ondule\w*|curly|wavy|raide\w*|straight|aile-de-corbeau)"
# Ages, genders, words of height and whole values of height.
AGES = r"(?:(?:(?:le|la|un|une|the|a) )?(?:jeune|vieux|vieille|young|old|elderly)(?: (?:homme|femme|garcon|fille|man|woman|boy|girl))?|(?:d['’]une |une )?(?:vingtaine|trentaine|quarantaine|cinquantaine|soixantaine) d['’]annees|(?:aged? )?\d+ (?:ans|years old))"
GENDERS = r"\b(?:homme|femme|garcon|fille|man|woman|boy|girl)\b"
HEIGHTS = r"\b(?:tall|short|grand|petit)\b"
HEIGHT_VALUES = r"(?:(?:un |a )?(?:petit|grand|short|small|tall)(?: homme| man)?|plus grand|plus petit|taller than his companion)"
# Whole values that speak of limbs.
ALL_LIMBS = r"tout en bras,? (?:en )?jambes"
STRONG_ARMS = r"(?:bras vigoureux|(?:strong|powerful|vigorous) arms?)"
# Marks that stay and injuries.
SCARS, WOUNDS = r"\b(?:cicatrice\w*|scar\w*)\b", r"\b(?:blessure\w*|wound\w*|injur\w*|brulure\w*|burns?)\b"
# Words by which properties of hair are told apart.
HAIR_WORDS = {
    "hair_color": COLORS,
    "hair_thickness": r"\b(?:epais\w*|thick\w*|thin|fin[es]*)\b",
    "hair_texture": r"\b(?:ondule\w*|boucle\w*|frise\w*|raide\w*|wavy|curly|straight|coarse|silky)\b",
    "hair_length": r"\b(?:long\w*|court\w*|short|cropped)\b",
    "hair_style": r"\b(?:folle|indiscipline\w*|desordre|chignon|natte\w*|coiff\w*|raie|messy|unruly|bun|braid\w*|parting|styled)\b",
}
# Words by which properties of limbs are told apart.
LIMB_WORDS = {
    "body_hair": r"\b(?:poilu\w*|hairy|body hair)\b",
    "skin_color": r"\b(?:bruni\w*|bronze\w*|tann?ed|tan)\b",
    "leg_shape": r"\b(?:galbe\w*|shapely)\b",
    "arm_build": r"\b(?:maigre\w*|muscle\w*|thin|muscular)\b",
}
# Exposed clothing and brightness of eyes.
EXPOSED, BRIGHT = r"\b(?:devoile\w*|exposed|uncovered)\b", r"\b(?:brillant\w*|bright|glacial|icy)\b"
# Beards and looks that pass.
PASSING_BEARD = r"\b(?:stubble|barbe de (?:deux|[0-9]+) jours?|two.day beard)\b"
PASSING_LOOK = r"\b(?:eclat glacial|icy gaze|cold gaze)\b"
# Attributes of what is physical and of what is worn.
PHYSICAL, WORN = ["age", "physical_appearance", "distinguishing_feature"], ["clothing", "accessory"]
# Fixed value: attributes of a wardrobe.
WARDROBE = r"wardrobe_[a-z0-9]+(?:_[a-z0-9]+)*"


#: Fields of a description by the traits that it gathers; of eyes, hair and skin by how a trait begins. Fixed values.
TRAIT_FIELD = {
    "facial_hair": "hair", "body_hair": "hair",
    "nose_shape": "facial_features", "cheekbones": "facial_features", "lips": "facial_features", "chin": "facial_features", "face_shape": "facial_features", "teeth": "facial_features",
    "age": "age_appearance", "clothing": "default_outfit", "accessory": "accessories",
}
FIELD_STARTS, OTHER_FIELD = {"eye_": "eyes", "hair_": "hair", "skin_": "skin"}, "build"


def field_of(trait: Column) -> Column:
    """The field of a description that a trait belongs to."""
    known = F.create_map(*[F.lit(x) for pair in TRAIT_FIELD.items() for x in pair])
    out = F.coalesce(known[trait], F.lit(OTHER_FIELD))
    for start, field in FIELD_STARTS.items():
        out = F.when(F.startswith(trait, F.lit(start)), field).otherwise(out)
    return out


def holds(text: Column, pattern: str) -> Column:
    return text.rlike("(?U)" + pattern)


def is_all(text: Column, pattern: str) -> Column:
    return text.rlike(rf"(?U)\A(?:{pattern})\z")


def named(text: Column, patterns: dict[str, str]) -> Column:
    """Keys whose pattern the text holds."""
    return F.array_compact(F.array(*[F.when(holds(text, p), F.lit(k)) for k, p in patterns.items()]))


def words(*values: str) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def bodies_of(value: Column, quotation: Column) -> Column:
    """Body parts that a value names; one that is only a colour or quality takes the part that its quotation names, if it names one."""
    own, quoted = named(value, BODY_CUES), named(quotation, BODY_CUES)
    bare = is_all(value, COLORS) | is_all(value, QUALITIES)
    return F.when((F.size(own) == 0) & bare & (F.size(quoted) == 1), quoted).otherwise(own)


def allowed_traits(value: Column, bodies: Column) -> Column:
    """Traits that a value may support; null if any."""
    traits = F.create_map(*[x for b, t in BODY_TRAITS.items() for x in (F.lit(b), words(*t))])
    general = F.when(F.size(bodies) > 0, F.array_distinct(F.flatten(F.transform(bodies, lambda b: traits[b]))))
    aged = F.when(holds(value, GENDERS), words("age", "gender")).otherwise(words("age"))
    start = F.when(is_all(value, AGES), aged).otherwise(general)
    tall = F.when(F.array_contains(bodies, "build") & holds(value, HEIGHTS), F.concat(start, words("height"))).otherwise(start)
    limbs = F.when(is_all(value, ALL_LIMBS), F.concat(tall, words("build"))).otherwise(tall)
    return (
        F.when(holds(value, SCARS), words("distinguishing_mark"))
        .when(holds(value, WOUNDS), words("injury"))
        .when(is_all(value, HEIGHT_VALUES), words("height"))
        .when(is_all(value, STRONG_ARMS), words("arm_build"))
        .otherwise(limbs)
    )


def trait_violations(rows: DataFrame) -> DataFrame:
    """The first rule that a trait breaks: evidence_id, trait, rule, detail (what the value would support).

    ``rows``: evidence_id, trait, kind, value, quotation, attribute. Only evidence of a physical attribute is asked what it describes;
    clothing, voices and the like, and rows whose attribute is null, break no rule here. Wording without a known cue breaks none
    either. Null values and quotations count as empty.
    """
    text = lambda c: plain(fold(F.coalesce(F.col(c), F.lit(""))))
    seen = rows.filter(F.col("attribute").isin(PHYSICAL)).select("evidence_id", "trait", "kind", text("value").alias("_v"), text("quotation").alias("_q"))
    value, trait = F.col("_v"), F.col("trait")
    seen = seen.withColumn("_b", bodies_of(value, F.col("_q")))
    bodies, everlasting = F.col("_b"), F.col("kind") == "global"
    seen = seen.withColumns({"_allowed": allowed_traits(value, bodies), "_hair": named(value, HAIR_WORDS), "_limb": named(value, LIMB_WORDS)})
    limbs = (F.size(bodies) > 0) & (F.size(F.array_except(bodies, words("legs", "arms", "hair"))) == 0) & F.arrays_overlap(bodies, words("legs", "arms"))
    outside = lambda c: (F.size(c) > 0) & ~F.array_contains(c, trait)
    rule = (
        F.when((trait == "context") & (F.col("kind") == "context"), None)
        .when(F.col("_allowed").isNotNull() & ~F.array_contains("_allowed", trait), "trait_subject")
        .when((bodies == words("hair")) & outside("_hair"), "hair_property")
        .when(limbs & outside("_limb"), "limb_property")
        .when(limbs & everlasting & holds(value, EXPOSED), "exposed_clothing")
        .when((trait == "eye_color") & holds(value, BRIGHT) & ~holds(value, COLORS), "eye_brightness")
        .when(everlasting & (holds(value, PASSING_BEARD) | holds(value, PASSING_LOOK)), "passing_trait")
    )
    detail = F.when(rule == "trait_subject", F.col("_allowed")).when(rule == "hair_property", F.col("_hair")).when(rule == "limb_property", F.col("_limb")).otherwise(words())
    return seen.select("evidence_id", "trait", rule.alias("rule"), F.array_join(F.array_sort(F.array_distinct(detail)), ",").alias("detail")).filter("rule IS NOT NULL")


def global_violations(rows: DataFrame) -> DataFrame:
    """Traits said to hold throughout whose evidence is not explicit, persistent and physical: evidence_id, trait, rule.

    ``rows``: evidence_id, trait, kind, classification, persistence, attribute; a null among the last three is not enough.
    """
    enough = (F.col("classification") == "explicit") & (F.col("persistence") == "persistent") & F.col("attribute").isin(PHYSICAL)
    worn = (F.col("persistence") == "temporary") | F.col("attribute").isin(WORN)
    rule = F.when(F.coalesce(enough, F.lit(False)), None).when(F.coalesce(worn, F.lit(False)), "temporary_global").otherwise("weak_global")
    return rows.filter("kind = 'global'").select("evidence_id", "trait", rule.alias("rule")).filter("rule IS NOT NULL")


def shape_rule(kind: Column, trait: Column, fields: list[str]) -> Column:
    """The rule that one visual trait breaks by itself."""
    blank = F.lit(False)
    for f in fields:
        blank = blank | (F.length(F.trim(F.coalesce(trait[f], F.lit("")))) == 0)
    blank = blank | ~trait["scope"].isin("intrinsic", "scene") | (T.attribute_key(trait["attribute"]) == "")
    worn = (trait["scope"] == "scene") & trait["attribute"].rlike(rf"\A(?:{WARDROBE})\z")
    return (
        F.when(F.coalesce(blank, F.lit(True)), "invalid_trait")
        .when((kind == "characters") & ~worn, "character_trait")
        .when((kind == "objects") & (trait["scope"] != "intrinsic"), "object_trait")
    )


TRAIT_FIELDS = ["attribute", "description", "scope", "evidence"]


def evidence_violations(observations: DataFrame, texts: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """Broken rules of visual observations: keys, entity, trait_no (0 for the observation itself), rule.

    ``observations``: keys, entity, kind, presence, visual_traits (array of struct attribute, description, scope, evidence). A
    trait must have its fields, the scope of its kind, and evidence that quotes the passage of its own keys.
    """
    known = F.coalesce(F.col("presence").isin(PRESENCE), F.lit(False)) & F.col("visual_traits").isNotNull()
    whole = observations.filter(~known).select(*keys, "entity", F.lit(0).alias("trait_no"), F.lit("invalid_observation").alias("rule"))
    traits = observations.filter(known).select(*keys, "entity", "kind", F.posexplode("visual_traits").alias("_i", "_t"))
    met = traits.join(texts.select(*keys, T.comparison_text(F.col(text_col)).alias("_text")), keys, "left")
    quoted = F.contains(F.col("_text"), T.comparison_text(F.col("_t.evidence")))
    rule = F.coalesce(shape_rule(F.col("kind"), F.col("_t"), TRAIT_FIELDS), F.when(~F.coalesce(quoted, F.lit(False)), "evidence_not_local"))
    return whole.unionByName(met.select(*keys, "entity", (F.col("_i") + 1).alias("trait_no"), rule.alias("rule")).filter("rule IS NOT NULL"))


def reference_violations(references: DataFrame) -> DataFrame:
    """Broken rules of visual references: entity, place ('common' or chapter/sequence), rule.

    ``references``: entity, kind, common_traits and scenes (array of struct chapter, sequence (string), presence, traits,
    excluded_attributes). Common traits are intrinsic; a scene has a number from 1, a presence, well-formed traits and no blank exclusion.
    """
    common = references.select("entity", "kind", F.lit("common").alias("place"), F.explode("common_traits").alias("_t"))
    in_common = F.coalesce(shape_rule(F.lit("any"), F.col("_t"), TRAIT_FIELDS), F.when(F.col("_t.scope") != "intrinsic", "common_not_intrinsic"), shape_rule(F.col("kind"), F.col("_t"), TRAIT_FIELDS))
    scenes = references.select("entity", "kind", F.explode("scenes").alias("_s")).withColumn("place", F.concat_ws("/", "_s.chapter", "_s.sequence"))
    sound = F.col("_s.sequence").rlike(r"\A[1-9][0-9]*\z") & F.col("_s.presence").isin(PRESENCE) & F.col("_s.traits").isNotNull() & ~F.exists("_s.excluded_attributes", lambda x: F.coalesce(x, F.lit("")) == "")
    broken = scenes.filter(~F.coalesce(sound, F.lit(False))).select("entity", "place", F.lit("invalid_scene").alias("rule"))
    traits = scenes.select("entity", "kind", "place", F.explode("_s.traits").alias("_t"))
    out = common.select("entity", "place", in_common.alias("rule")).unionByName(traits.select("entity", "place", shape_rule(F.col("kind"), F.col("_t"), TRAIT_FIELDS).alias("rule")))
    return out.filter("rule IS NOT NULL").unionByName(broken)
