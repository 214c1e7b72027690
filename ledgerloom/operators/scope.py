"""Scope of a contract from its descriptions: evidence by rule and place, and a ladder of decisions.

Two descriptions, of a procedure and of an item, are read on their own. From each the tail
that only says where it is goes, and names of places that sound like assets are blotted out
by as many underscores, so that evidence keeps its place in the text. Roads and other assets
are looked for in channels of their own, with homonyms of the other channel blotted out.
Evidence of other assets is set aside where what stands before it shows that it is no asset:
a road that leads to a hospital, or a street called after one.

A row's texts never leave the row: there is no shuffle. Null texts are empty; a text of any
length is read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The rules, masks and contexts of the public screening that is reproduced here.
ROAD_RULES = {
    "R01_road_network": r"\bCARRETERAS?\b|\bAUTOPISTAS?\b|\bCAMINOS?\s+(?:VECINAL(?:ES)?|RURAL(?:ES)?|DEPARTAMENTAL(?:ES)?|NACIONAL(?:ES)?)\b|\bTROCHAS?\s+CARROZABLES?\b|\bVIAS?\s+(?:VECINAL(?:ES)?|DEPARTAMENTAL(?:ES)?|NACIONAL(?:ES)?|URBANAS?|INTERURBANAS?)\b",
    "R02_transport_service": r"\b(?:SERVICIOS?\s+DE\s+)?TRANSITABILIDAD\b|\bMOVILIDAD\s+URBANA\b|\bINFRAESTRUCTURA\s+(?:VIAL|VEHICULAR)\b|\bACCESOS?\s+VEHICULAR(?:ES)?\b|\bINTERCAMBIOS?\s+VIALES?\b",
    "R03_road_surface": r"\bPAVIMENT(?:ACION|O|OS|AR)\b|\bASFALT(?:ADO|ADOS|ICA|ICO|ICAS|ICOS)\b|\bPISTAS?\b|\bCALZADAS?\b|\bCICLOVIAS?\b",
    "R04_road_bridge": r"\bPUENTES?\s+(?:VEHICULAR(?:ES)?|CARROZABLES?)\b|\b(?:CONSTRUCCION|RENOVACION|REPOSICION|REHABILITACION|REPARACION|MEJORAMIENTO|AMPLIACION)\s+(?:DE(?:L| LOS)?\s+)?PUENTES?\b",
    "R05_vehicular_network": r"\bSISTEMA\s+VIAL\b|\bRED\s+VIAL\b|\bVIAS?\s+(?:DE\s+ACCESO|EXPRESAS?|CARROZABLES?)\b|\bPASOS?\s+A\s+DESNIVEL\b|\bCORREDOR(?:ES)?\s+VIAL(?:ES)?\b",
    "R06_street_intervention": r"\b(?:MEJORAMIENTO|REHABILITACION|RENOVACION|RECONSTRUCCION|CONSTRUCCION|PAVIMENTACION)\s+(?:DE(?:L| LA| LAS| LOS)?\s+)?(?:CALLES?|AVENIDAS?|JIRON(?:ES)?|JR\.?)\b",
    "R07_road_circulation": r"\bCIRCULACION\s+VIAL\b|\bTRANSITO\s+VEHICULAR\b",
    "R08_explicit_road_service": r"\bSERVICIOS?\s+VIALES?\b|\bMEJORAMIENTO\s+VIAL\b|\b(?:CREACION|MEJORAMIENTO|CONSTRUCCION|REHABILITACION|RENOVACION|REPARACION)\s+(?:DE(?:L|\s+LA|\s+LAS|\s+LOS)?\s+)?(?:AV\.|JR\.|CA\.)",
}
OTHER_RULES = {
    "N01_education": r"\bSERVICIOS?\s+EDUCATIVOS?\b|\bINFRAESTRUCTURA\s+EDUCATIVA\b|\bINSTITUCION(?:ES)?\s+EDUCATIVA(?:S)?\b|\bLOCAL(?:ES)?\s+ESCOLAR(?:ES)?\b|\bAULAS?\b",
    "N02_water_sanitation": r"\bAGUA\s+POTABLE\b|\bALCANTARILLADO\b|\bSANEAMIENTO\b|\bDISPOSICION\s+(?:SANITARIA\s+)?DE\s+EXCRETAS\b|\bUNIDADES?\s+BASICAS?\s+DE\s+SANEAMIENTO\b",
    "N03_health": r"\bSERVICIOS?\s+DE\s+SALUD\b|\bESTABLECIMIENTOS?\s+DE\s+SALUD\b|\bCENTROS?\s+DE\s+SALUD\b|\bPUESTOS?\s+DE\s+SALUD\b|\bINFRAESTRUCTURA\s+HOSPITALARIA\b",
    "N04_irrigation": r"\bSISTEMAS?\s+DE\s+RIEGO\b|\bCANALES?\s+DE\s+RIEGO\b|\bIRRIGACION\b|\bAGUA\s+PARA\s+(?:USO\s+)?RIEGO\b",
    "N05_nonroad_facility": r"\bCOMISARIAS?\b|\bESTADIOS?\b|\bCOMPLEJOS?\s+DEPORTIVOS?\b|\bPALACIO\s+MUNICIPAL\b|\bMERCADOS?\s+DE\s+ABASTOS\b|\bCEMENTERIOS?\b",
    "N06_education_services": r"\bEDUCACION\s+(?:INICIAL|PRIMARIA|SECUNDARIA|SUPERIOR|BASICA)\b|\bSERVICIOS?\s+(?:BASICOS?\s+)?(?:DE\s+)?EDUCACION\b|\bLABORATORIOS?\b|\b(?:I\s*\.\s*E\s*\.(?:\s*[IPSM]\s*\.)?|INSTITUTO\s+SUPERIOR|LOCAL\s+UNIVERSITARIO)\b",
    "N07_electricity": r"\bELECTRIFICACION\b|\bENERGIA\s+ELECTRICA\b|\bSERVICIO\s+ELECTRICO\b|\bSUMINISTRO\s+ELECTRICO\b|\bSUB\s*ESTACIONES?\s+ELECTRICAS?\b|\bREDES\s+PRIMARIAS\b",
    "N08_recreation_civic": r"\bSERVICIOS?\s+(?:DE\s+)?(?:RECREACION|ESPARCIMIENTO|DEPORTIVOS?|ADMINISTRACION\s+DE\s+JUSTICIA)\b|\bLOCAL(?:ES)?\s+(?:COMUNAL(?:ES)?|MULTIUSO|INSTITUCIONAL(?:ES)?)\b|\bCENTRO\s+(?:FERIAL|CULTURAL)\b|\bPARQUES?\b|\bPLAZA\s+DE\s+ARMAS\b|\bESPACIOS?\s+PUBLICOS?\b|\bAMBIENTE\s+DE\s+RECREACION\b",
    "N09_water_infrastructure": r"\b(?:SISTEMA|SERVICIO|CANAL|INFRAESTRUCTURA)\s+(?:PARA\s+|DE\s+)?RIEGO\b|\bAGUA\s+PARA\s+EL\s+RIEGO\b|\bDEFENSA\s+RIBEREN[AO]\b|\bPROTECCION\s+(?:EN\s+)?RIBERAS?\b|\bPROTECCION\s+(?:EN\s+)?RIVERAS?\b|\bDRENAJE\s+PLUVIAL\b",
    "N10_facilities": r"\bHANGAR\b|\bALMACEN(?:ES)?\b|\bBA[NÑ]OS?\s+O\s+SERVICIOS\s+SANITARIOS\b|\bSEDES?\s+(?:ADMINISTRATIVAS?|INSTITUCIONALES?)\b",
    "N13_education_facilities": r"\bEDUCACION\b|\bEDUCATIV[AO]S?\b|(?<!\w)I\s*\.\s*E\s*\.(?:\s*[IPSM]\s*\.)?|\bUNIVERSIDAD(?:ES)?\b|\bCOLEGIOS?\b|\bINSTITUTOS?\b|\bESCUELAS?\b",
    "N14_water_agriculture": r"\bDESAGUE\b|\bAGUAS\s+RESIDUALES\b|\bINFRAESTRUCTURA\s+SANITARIA\b|\bAGUA\s+PARA\s+USO\s+AGRICOLA\b|\bSISTEMA\s+DE\s+AGUA\b|\bSERVICIOS?\s+DE\s+AGUA\b|\bRESERVORIOS?\b|\bREPRESAS?\b|\bAGUA\s+Y\s+SANEAMIENTO\b",
    "N15_flood_protection": r"\bPROTECCION\s+(?:FRENTE\s+A|Y\s+CONTROL\s+DE)\s+(?:INUNDACIONES|ALUVIONES)\b|\bDEFENSA\s+RIBERENA\b|\bENCAUZAMIENTO\b",
    "N16_other_buildings": r"\bSERVICIOS?\s+MIGRATORIOS?\b|\bSEDE\s+DE\b|\bARCHIVO\s+REGIONAL\b|\bCENTRO\s+PENITENCIARIO\b|\bSEGURIDAD\s+CIUDADANA\b|\bTERMINAL\s+PESQUERO\b|\bCAMAL\b|\bMATADERO\b|\bSERVICIOS?\s+FUNERARIOS?\b|\bSERVICIOS?\s+CULTURALES?\b",
    "N17_health_facilities": r"\b(?:CONSTRUCCION|MEJORAMIENTO|AMPLIACION|REHABILITACION)\s+(?:DE(?:L)?\s+)?HOSPITAL(?:ES)?\b|\bATENCION\s+DE\s+SALUD\b|\bATENCION\s+MEDICA\b",
    "N18_power_network": r"\bSISTEMA\s+ELECTRICO\b|\bREDES?\s+DE\s+DISTRIBUCION\b|\bLINEAS?\s+PRIMARIAS\b|\bALUMBRADO\s+PUBLICO\b",
    "N19_production_environment": r"\bCADENA\s+PRODUCTIVA\b|\bACTIVIDAD\s+ARTESANAL\b|\bRESIDUOS\s+SOLIDOS\b|\bMANEJO\s+DE\s+LIXIVIADOS\b|\bCELDAS\s+PARA\s+RESIDUOS\b|\bRELLENO\s+SANITARIO\b|\bINFRAESTRUCTURA\s+PRODUCTIVA\b",
    "N20_social_institutional": r"\bPRONOEI\b|\bHABITABILIDAD\s+INSTITUCIONAL\b|\bOFICINAS?\s+ADMINISTRATIVAS?\b|\bLOCAL\s+SOCIAL\b|\bCASA\s+DE\s+REPOSO\b|\bSERVICIOS?\s+SOCIO\s*CULTURALES?\b|\bINVESTIGACION\s+POLICIAL\b|\bEDIFICIO\b|\bPALACIO\b",
    "N21_flood_control": r"\bPROTECCION\s+CONTRA\s+INUNDACIONES\b|\bPROTECCION\s+FRENTE\s+A\s+INUNDACIONES\b|\bCONTROL\s+DE\s+INUNDACIONES\b|\bPROTECCION\s+EN\s+RIBERAS\b",
    "N22_power_assets": r"\b(?:MEDIA|ALTA|BAJA)\s+TENSION\b|\bALIMENTADORES?\s+(?:ELECTRICOS?|DE\s+\d)|\b(?:REDES?|LINEAS?)\s+ELECTRICAS?\b",
    "N23_sports_assets": r"\bPISTAS?\s+(?:DE\s+)?ATLETISMO\b|\bCAMPOS?\s+DEPORTIVOS?\b|\bLOSAS?\s+(?:DEPORTIVAS?|MULTIDEPORTIVAS?)\b|\bTRIBUNAS?\b|\bSERVICIOS?\s+DE\s+PRACTICA\s+DEPORTIVA\b",
    "N24_other_services": r"\bSERVICIOS?\s+ACADEMICOS?\b|\bCENTROS?\s+DE\s+CONVENCIONES\b|\bMERCADOS?\s+(?:CENTRAL(?:ES)?(?:\s+DE\s+ABASTOS?)?|DE\s+ABASTO)\b",
    "N25_agricultural_drainage": r"\bDRENAJE\s+AGRICOLA\b|\bEVACUACION\s+DE\s+AGUAS\s+PLUVIALES\b|\bAREAS?\s+DEGRADADAS?\b",
    "N26_education_initials": r"(?<!\w)I\s*\.\s*E(?=\s|\.|$)",
    "N27_named_nonroad_services": r"\bRESIDENCIA\s+ESCOLAR\b|\bBOCATOMA\s+DE\s+RIEGO\b|\bCANALES?\s+DE\s+REGADIO\b|\bLIMPIEZA\s+PUBLICA\b|\bBOTADERO\b|\bDESEMBARCADERO\s+PESQUERO\b|\bINFRAESTRUCTURA\s+PESQUERA\b|\bESTABLECIMIENTO\s+PENITENCIARIO\b|\bSUBESTACION\s+DE\s+TRANSFORMACION\b|\bCOLISEO\b|\bSERVICIO\s+RECREATIVO\b|\bTERMINAL\s+TERRESTRE\b",
}
AIR = r"\bPISTAS?\s+DE\s+ATERRIZAJE\b|\bAERODROMO\b|\bTERMINAL\s+AEROPORTUARIO\b"
ON_FOOT = r"\bPEATONAL(?:ES)?\b|\bVEREDAS?\b|\bESCALINATAS?\b|\bESCALERAS?\b|\bCICLOVIAS?\b|\bMALECON(?:ES)?\b|\bALAMEDAS?\b"
MOTOR = r"\bVEHICULAR(?:ES)?\b|\bCARRETERAS?\b|\bAUTOPISTAS?\b|\bCAMINOS?\s+VECINAL(?:ES)?\b|\bVIAS?\s+(?:VECINAL(?:ES)?|DEPARTAMENTAL(?:ES)?|NACIONAL(?:ES)?)\b|\bTROCHAS?\s+CARROZABLES?\b|\bPISTAS?\b|\bCALZADAS?\b|\bPASOS?\s+A\s+DESNIVEL\b|\bTRANSITO\s+VEHICULAR\b"
REGION = r"\b(?:EN (?:EL|LOS) DISTRITOS? DE|DEL DISTRITO DE|DISTRITO DE|PROVINCIA DE|DEPARTAMENTO DE)\b"
NAMED_PLACE = r"\b(AVENIDA|AV\.|JIRON|JR\.|CALLES?|CA\.|A\.\s*H\.?|AA\.\s*HH\.?)\s+(?:DEL\s+)?(?:CEMENTERIO|MERCADO CENTRAL|PARQUE)(?!\w)"
SPORTS_TRACK, LOCALITY = r"\bPISTAS?\s+(?:DE\s+)?ATLETISMO\b", r"\bLOCALIDAD\s+DE\s+CALZADA\b"
ADDRESS = r"\b(?:UBICAD[AO]S?\s+EN|CON\s+DIRECCION\s+EN|CON\s+DOMICILIO\s+EN)\b"
ROAD_DRAINAGE = r"\b(?:DRENAJE\s+PLUVIAL|EVACUACION\s+DE\s+AGUAS\s+PLUVIALES|ALCANTARILLADO\s+PLUVIAL)\b"
LEADS_TO = r"(?:ACCESO|ACCESOS)\s+(?:(?:VEHICULAR|VEHICULARES)\s+)?(?:A|AL|A LA|A LAS|A LOS)\s*$"
STREET = r"(?:JR\.?|JIRON|CALLE|AV\.?|AVENIDA)\s+"
STREET_LIFE = r"\b(?:TRANSITABILIDAD|MOVILIDAD|INFRAESTRUCTURA VIAL)\b"
LANDSCAPE = ("PARQUE", "PARQUES", "PLAZA DE ARMAS")
NETWORKS = ("R01_road_network", "R05_vehicular_network")

REASONS = {
    "airport": ("excluded", "an asset of an airport"),
    "airport_and_road": ("unresolved", "an asset of an airport beside a road network"),
    "on_foot": ("excluded", "for walking or cycling only"),
    "road": ("included", "a road or a service of roads"),
    "other": ("excluded", "another asset and no road"),
    "mixed": ("unresolved", "a road beside another asset"),
    "nothing": ("unresolved", "no evidence of an asset"),
}
EVIDENCE = "array<struct<rule:string,start:int,hit:string>>"


def by_rule(c: Column, rules: dict[str, str]) -> Column:
    """All matches as an array of (rule, start, hit), rule by rule."""
    # Places are worked out once for all rules, of those that match.
    found = F.filter(F.array(*(F.struct(F.lit(r).alias("rule"), T.matches(c, p).alias("m")) for r, p in rules.items())), lambda x: F.size(x["m"]["found"]) > 0)
    each = F.transform(found, lambda x: F.transform(T.placed(x["m"]), lambda h: F.struct(x["rule"].alias("rule"), h["start"].alias("start"), h["hit"].alias("hit"))))
    return F.flatten(each).cast(EVIDENCE)


def _led_to(text: Column):
    return lambda e: F.substring(text, F.lit(1), F.instr(text, e["hit"]) - 1).rlike(LEADS_TO)


def classify_scope(df: DataFrame, procedure: str, item: str) -> DataFrame:
    """df with decision, reason, rules, and evidence: (field, rule, start, stop, hit), where start and stop count characters of the field's normal text from 1."""
    out = df
    for field, column in (("p", procedure), ("i", item)):
        # A column for each step: an expression would be repeated wherever its text is named.
        out = out.withColumn("_bare", T.upper_norm(F.col(column))).withColumn("_bare", T.before(F.col("_bare"), REGION))
        out = out.withColumn(f"_{field}", T.masked(F.col("_bare"), NAMED_PLACE, keep=1))
        plain = F.col(f"_{field}")
        out = out.withColumn("_road", T.masked(plain, SPORTS_TRACK)).withColumn("_road", T.before(F.col("_road"), ADDRESS)).withColumn("_road", T.masked(F.col("_road"), LOCALITY))
        out = out.withColumn(f"_{field}r", by_rule(F.col("_road"), ROAD_RULES))
        out = out.withColumn("_other", F.when(F.size(f"_{field}r") > 0, T.masked(plain, ROAD_DRAINAGE)).otherwise(plain))
        out = out.withColumn(f"_{field}n", by_rule(F.col("_other"), OTHER_RULES))
        # Where a road leads to is no asset, if all that was found is so introduced.
        led = F.forall(f"_{field}n", _led_to(plain))
        out = out.withColumn(f"_{field}n", F.when((F.size(f"_{field}r") > 0) & led, F.array().cast(EVIDENCE)).otherwise(F.col(f"_{field}n")))
    out = out.withColumn("_all", F.concat_ws(" | ", "_p", "_i"))
    roads = F.concat("_pr", "_ir")
    out = out.withColumn("_road", F.size(roads) > 0).withColumn("_network", F.exists(roads, lambda e: e["rule"].isin(*NETWORKS)))
    called = lambda e: (e["rule"] == "N17_health_facilities") & F.rlike(F.col("_all"), F.concat(F.lit(STREET + r"\Q"), e["hit"], F.lit(r"\E")))
    beside = lambda e: (e["hit"] == "DRENAJE PLUVIAL") | ((e["rule"] == "N08_recreation_civic") & e["hit"].isin(*LANDSCAPE) & F.col("_all").rlike(STREET_LIFE))
    stays = lambda e: ~called(e) & ~(F.col("_road") & beside(e))
    out = out.withColumns({f"_{f}n": F.filter(f"_{f}n", stays) for f in "pi"})
    air, foot = F.regexp_extract("_all", AIR, 0), F.regexp_extract("_all", ON_FOOT, 0)
    other = F.size(F.concat("_pn", "_in")) > 0
    asked = {
        "airport_and_road": (air != "") & F.col("_network"), "airport": air != "", "on_foot": (foot != "") & ~F.col("_all").rlike(MOTOR) & ~F.col("_network"),
        "road": F.col("_road") & ~other, "other": other & ~F.col("_road"), "mixed": F.col("_road") & other, "nothing": F.lit(True),
    }
    out = out.withColumn("_why", F.coalesce(*(F.when(c, F.lit(k)) for k, c in asked.items())))
    pick = lambda i: F.coalesce(*(F.when(F.col("_why") == k, F.lit(v[i])) for k, v in REASONS.items()))
    placed = lambda c, field: F.transform(c, lambda e: F.struct(F.lit(field).alias("field"), e["rule"].alias("rule"), e["start"].alias("start"), (e["start"] + F.length(e["hit"]) - 1).alias("stop"), e["hit"].alias("hit")))
    extra = F.when(F.col("_why").isin("airport", "airport_and_road"), F.array(F.lit("N11_airport_asset"))).when(F.col("_why") == "on_foot", F.array(F.lit("N12_nonmotorized_only"))).otherwise(F.array().cast("array<string>"))
    names = F.concat(F.transform(F.concat("_pr", "_ir", "_pn", "_in"), lambda e: e["rule"]), extra)
    return out.withColumns({
        "decision": pick(0), "reason": pick(1), "rules": F.array_join(F.array_sort(F.array_distinct(names)), " | "),
        "evidence": F.concat(placed("_pr", "procedure"), placed("_pn", "procedure"), placed("_ir", "item"), placed("_in", "item")),
    }).drop("_p", "_i", "_pr", "_ir", "_pn", "_in", "_all", "_bare", "_other", "_road", "_network", "_why")
