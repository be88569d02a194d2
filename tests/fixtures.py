"""Tiny hand-made input files in the reference's layouts (FIXTURES.md §1).

Each builder writes into a folder and returns the path. The rows carry the
"""

from __future__ import annotations

import gzip
import json
import os

FLAGS_CSV = ('﻿"Flag","Flags"\n' + "".join(
    f'"{c}","{t}"\n' for c, t in [
        ("A", "Official figure"), ("B", "Time series break"), ("E", "Estimated value"),
        ("F", "Forecast value"), ("I", "Imputed value"),
        ("M", "Missing value (data cannot exist, not applicable)"), ("O", "Missing value"),
        ("P", "Provisional value"), ("Q", "Missing value; suppressed"),
        ("U", "Low reliability"), ("X", "Figure from international organizations")]))

YEARS = [1960, 1961, 2022, 2023]  # K12 edges


def _write(path: str, text: str) -> str:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return path


def production(folder: str) -> str:
    """Wide production file. Rows: a NULL Unit (K2), value without flag and the
    reverse, a dirty value '-' (K6), M49 with a leading quote."""
    head = ["Area Code", "Area Code (M49)", "Area", "Item Code", "Item Code (CPC)", "Item",
            "Element Code", "Element", "Unit"]
    for y in YEARS:
        head += [f"Y{y}", f"Y{y}F", f"Y{y}N"]
    rows = [
        # Germany wheat yield: full series
        ["79", "'276", "Germany", "15", "'0111", "Wheat", "5412", "Yield", "kg/ha",
         "100", "A", "", "110", "E", "", "130", "A", "n1", "140", "", ""],
        # Germany wheat production: value without flag, flag without value
        ["79", "'276", "Germany", "15", "'0111", "Wheat", "5510", "Production", "t",
         "5", "", "", "", "M", "", "7", "A", "", "-", "", ""],
        # NULL unit: single pass keeps the flag, the three-melt join loses it (K2)
        ["2", "'004", "Afghanistan", "15", "'0111", "Wheat", "5412", "Yield", "",
         "50", "A", "", "55", "E", "", "60", "X", "", "65", "A", ""],
        # a second item for Germany
        ["79", "'276", "Germany", "221", "'01371", "Almonds, in shell", "5412", "Yield",
         "kg/ha", "", "", "", "20", "I", "", "30", "A", "", "35", "A", ""],
    ]
    text = ",".join(f'"{h}"' for h in head) + "\n"
    for r in rows:
        text += ",".join(f'"{v}"' if v != "" else "" for v in r) + "\n"
    return _write(os.path.join(folder, "production.csv"), text)


def country_codes(folder: str) -> str:
    """Codes hub with Namibia's ISO2 ``NA`` (K9)."""
    return _write(os.path.join(folder, "codes.csv"),
                  "iso2,iso3,iso_num,country,country_common\n"
                  "DE,DEU,276,Germany,Germany\n"
                  "AF,AFG,4,Afghanistan,Afghanistan\n"
                  "NA,NAM,516,Namibia,Namibia\n")


def surface_temperature(folder: str) -> str:
    """Monthly temperature with the duplicated header (K8); two names for DEU (K14 off)."""
    text = ("Entity,Code,year,Day,Average surface temperature,Average surface temperature\n")
    for y, t in [(1960, 8.0), (1961, 8.5), (2022, 10.25), (2023, 10.5)]:
        for m in (1, 7):
            text += f"Germany,DEU,{y},{y}-{m:02d}-15,{t + m / 10},{t}\n"
        text += f"Afghanistan,AFG,{y},{y}-01-15,{t + 5},{t}\n"
    return _write(os.path.join(folder, "temperature.csv"), text)


def urban_population(folder: str) -> str:
    text = "Entity,Code,Year,Urban population,Rural population\n"
    for y in YEARS:
        text += f"Germany,DEU,{y},{60_000_000 + y},{20_000_000 - y}\n"
        text += f"Afghanistan,AFG,{y},{5_000_000 + y},{15_000_000 + y}\n"
    return _write(os.path.join(folder, "urban.csv"), text)


def gdp_share(folder: str) -> str:
    text = ('Entity,Code,Year,"Agriculture, forestry, and fishing, value added (% of GDP)"\n')
    for y in YEARS:
        text += f"Germany,DEU,{y},{1.0 + (y % 7) / 10}\n"
        text += f"Afghanistan,AFG,{y},{25.0 + (y % 5)}\n"
    return _write(os.path.join(folder, "gdp.csv"), text)


def emissions(folder: str) -> str:
    name = ("Change in global mean surface temperature caused by greenhouse gas emissions "
            "from agriculture and land use")
    text = f'Entity,Code,Year,"{name}"\n'
    for y, v in [(1960, 0.0001234567), (1961, 0.0002345678), (2022, 0.003)]:
        text += f"Germany,DEU,{y},{v}\n"
    return _write(os.path.join(folder, "emissions.csv"), text)


def religion_sheet(folder: str) -> str:
    """Sheet export with text numbers (K6) and the world total and a NULL country (K15)."""
    text = ("row_number,level,Nation_fk,Region,Year,Country,Christians,Muslims,Hindus,"
            "Buddhists,Folk Religions,Other Religions,Jews,All Religions\n"
            '1,1,,World,2010,All Countries,"2,000,000","1,500,000","1,000,000",'
            '"500,000","400,000","50,000","10,000","6,000,000"\n'
            '2,2,276,Europe,2010,Germany,"58,000,000","4,000,000","< 10,000",'
            '"< 10,000","< 10,000","100,000","200,000","82,000,000"\n'
            '3,2,,Europe,2010,,"1","1","1","1","1","1","1","7"\n')
    return _write(os.path.join(folder, "religion.csv"), text)


def cpi_yearly(folder: str) -> str:
    """Yearly CPI files; 1996 has its columns in another order and an extra one (SRC-2, K16)."""
    d = os.path.join(folder, "cpi")
    _write(os.path.join(d, "CPI-1995.csv"),
           "country,iso,score,rank\nGermany,DEU,8.14,1\nAfghanistan,AFG,,2\n")
    _write(os.path.join(d, "CPI-1996.csv"),
           "rank,score,extra,iso,country\n1,8.27,x,DEU,Germany\n2,NaN,y,AFG,Afghanistan\n")
    return d


def cpi_sheet(folder: str) -> str:
    """Sheet export whose header is the third row (SRC-5)."""
    years = range(2012, 2023)
    head = "Country / Territory,ISO3,Region," + ",".join(f"CPI Score {y}" for y in years)
    text = ("CPI 2012-2022 timeseries,,\n"
            "source: sheet export,,\n"
            + head + "\n"
            + "Germany,DEU,WE/EU," + ",".join(str(79 + (y % 3)) for y in years) + "\n"
            + "Afghanistan,AFG,AP," + ",".join("" if y == 2013 else str(8 + y % 4)
                                               for y in years) + "\n"
            + "Total,,,\n")
    return _write(os.path.join(folder, "cpi_sheet.csv"), text)


STATIONS = [
    {"id": "ST001", "country": "DE", "name": {"en": "Station one"}},
    {"id": "ST002", "country": "DE", "name": {"en": "Station two"}},
    {"id": "ST003", "country": "AF", "name": {"en": "Station three"}},
    {"id": "ST004", "country": "NA", "name": {"en": "Station four"}},
    {"id": "ST005", "country": "FR", "name": {"en": "Station five"}},
]


def stations(folder: str) -> str:
    """Gzip JSON array of stations (SRC-4), including Namibia ``NA`` (K9)."""
    path = os.path.join(folder, "stations", "lite.json.gz")
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(path, "wt", encoding="utf-8") as f:
        json.dump(STATIONS, f)
    return path


def daily(folder: str) -> str:
    """Headerless gzip CSV per station (SRC-3). Station ST002 has no snow depth
    at all (K10); readings span 1959–2023 (K12)."""
    d = os.path.join(folder, "daily")
    os.makedirs(d, exist_ok=True)
    data = {
        "ST001": [("1959-12-31", 1.0, -1.0, 3.0, 1.0, 5, 180, 10.0, 30.0, 1010.0, 60),
                  ("1960-01-01", 2.0, -2.0, 4.0, 2.0, 10, 180, 12.0, 40.0, 1012.0, 120),
                  ("1960-07-01", 20.0, 15.0, 28.0, 0.5, 0, 90, 8.0, 20.0, 1015.0, 600),
                  ("2022-06-01", 22.0, 16.0, 30.0, None, 0, 90, 9.0, 25.0, 1016.0, 500),
                  ("2023-01-01", 5.0, 1.0, 7.0, 3.0, 2, 90, 9.0, 25.0, 1016.0, 100)],
        "ST002": [("1960-01-01", 4.0, 0.0, 6.0, 1.5, None, 200, 14.0, 50.0, 1011.0, 100),
                  ("2022-06-01", 24.0, 18.0, 31.0, 0.0, None, 200, 11.0, 35.0, 1014.0, 700)],
        "ST003": [("1960-01-01", -3.0, -8.0, 2.0, 4.0, 30, 0, 5.0, 15.0, 1020.0, 200)],
        "ST004": [("1960-01-01", 25.0, 18.0, 32.0, 0.0, 0, 0, 6.0, 18.0, 1009.0, 800)],
        "ST005": [("1960-01-01", 9.0, 9.0, 9.0, 9.0, 9, 9, 9.0, 9.0, 999.0, 9)],
    }
    for sid, rows in data.items():
        with gzip.open(os.path.join(d, f"{sid}.csv.gz"), "wt") as f:
            for r in rows:
                f.write(",".join("" if v is None else str(v) for v in r) + "\n")
    return d


def flags(folder: str) -> str:
    """Flag lookup with a byte-order mark and quoted cells (K9)."""
    return _write(os.path.join(folder, "flags.csv"), FLAGS_CSV)


def all_inputs(folder: str) -> dict[str, str]:
    return {
        "production": production(folder), "codes": country_codes(folder),
        "temperature": surface_temperature(folder), "urban": urban_population(folder),
        "gdp": gdp_share(folder), "emissions": emissions(folder),
        "religion": religion_sheet(folder), "cpi_yearly": cpi_yearly(folder),
        "cpi_sheet": cpi_sheet(folder), "stations": stations(folder),
        "daily": daily(folder), "flags": flags(folder),
    }
