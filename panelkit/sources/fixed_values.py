"""Fixed values that results depend on: indicator codes, display names, categories, labels, defaults."""

from __future__ import annotations

# fixed values: indicator codes in collection order; the first one is the default target
INDICATORS = [
    "SI.POV.GINI",
    "NY.GDP.MKTP.CD",
    "NY.GDP.MKTP.KD.ZG",
    "NY.GDP.PCAP.CD",
    "NY.GDP.PCAP.PP.CD",
    "NV.AGR.TOTL.ZS",
    "NV.IND.TOTL.ZS",
    "NV.SRV.TOTL.ZS",
    "SP.POP.TOTL",
    "SP.URB.TOTL",
    "SP.URB.GROW",
    "SP.RUR.TOTL",
    "SP.POP.DPND",
    "SP.DYN.TFRT.IN",
    "SH.XPD.CHEX.GD.ZS",
    "SH.XPD.CHEX.PC.CD",
    "SH.XPD.GHED.GD.ZS",
    "SH.XPD.PVTD.CH.ZS",
    "SE.PRM.ENRL",
    "SE.SEC.ENRL",
    "SE.XPD.TOTL.GD.ZS",
    "SL.TLF.CACT.ZS",
    "SL.TLF.CACT.MA.ZS",
    "SL.TLF.CACT.FE.ZS",
    "SL.UEM.TOTL.ZS",
    "SL.UEM.TOTL.MA.ZS",
    "SL.UEM.TOTL.FE.ZS",
    "SL.UEM.1524.ZS",
    "SL.AGR.EMPL.ZS",
    "SL.IND.EMPL.ZS",
    "SL.SRV.EMPL.ZS",
    "NE.EXP.GNFS.ZS",
    "NE.IMP.GNFS.ZS",
    "BX.KLT.DINV.WD.GD.ZS",
    "BN.CAB.XOKA.GD.ZS",
    "FR.INR.DPST",
    "PA.NUS.FCRF",
    "IT.NET.USER.ZS",
    "EG.ELC.ACCS.ZS",
    "EG.ELC.ACCS.UR.ZS",
    "EG.ELC.ACCS.RU.ZS",
    "AG.LND.FRST.ZS",
    "AG.LND.AGRI.ZS",
    "ER.H2O.FWTL.K3",
    "ER.H2O.FWST.ZS",
    "EG.USE.COMM.FO.ZS",
    "EG.FEC.RNEW.ZS",
    "EG.ELC.RNEW.ZS",
    "EN.ATM.PM25.MC.M3",
    "AG.PRD.CROP.XD",
    "AG.YLD.CREL.KG",
    "SG.GEN.PARL.ZS",
    "SE.ENR.PRIM.FM.ZS",
]

# fixed values: display names of indicator codes and derived features
DISPLAY_NAMES = {
    "NY.GDP.PCAP.CD": "GDP per capita (current $)",
    "NY.GDP.MKTP.CD": "GDP (current $)",
    "NY.GDP.PCAP.PP.CD": "GDP per capita (PPP)",
    "NY.GDP.MKTP.KD.ZG": "GDP growth rate",
    "NV.SRV.TOTL.ZS": "Services (% GDP)",
    "NV.AGR.TOTL.ZS": "Agriculture (% GDP)",
    "NV.IND.TOTL.ZS": "Industry (% GDP)",
    "SP.POP.TOTL": "Total population",
    "SP.POP.DPND": "Dependency ratio",
    "SP.DYN.TFRT.IN": "Fertility rate",
    "SP.URB.TOTL": "Urban population",
    "SP.RUR.TOTL": "Rural population",
    "SP.URB.GROW": "Urban population growth",
    "SH.XPD.CHEX.GD.ZS": "Health expenditure (% GDP)",
    "SH.XPD.GHED.GD.ZS": "Gov health expenditure (% GDP)",
    "SH.XPD.CHEX.PC.CD": "Health expenditure per capita",
    "SH.XPD.PVTD.CH.ZS": "Private health expenditure (%)",
    "SE.PRM.ENRL": "Primary school enrollment",
    "SE.SEC.ENRL": "Secondary school enrollment",
    "SE.XPD.TOTL.GD.ZS": "Education expenditure (% GDP)",
    "SE.ENR.PRIM.FM.ZS": "Primary gender parity index",
    "SL.TLF.CACT.ZS": "Labor participation rate",
    "SL.UEM.TOTL.ZS": "Unemployment rate",
    "SL.UEM.1524.ZS": "Youth unemployment rate",
    "SL.TLF.CACT.MA.ZS": "Male labor participation",
    "SL.TLF.CACT.FE.ZS": "Female labor participation",
    "SL.UEM.TOTL.MA.ZS": "Male unemployment rate",
    "SL.UEM.TOTL.FE.ZS": "Female unemployment rate",
    "SL.IND.EMPL.ZS": "Industrial employment (%)",
    "SL.AGR.EMPL.ZS": "Agricultural employment (%)",
    "SL.SRV.EMPL.ZS": "Services employment (%)",
    "NE.EXP.GNFS.ZS": "Exports (% GDP)",
    "NE.IMP.GNFS.ZS": "Imports (% GDP)",
    "BX.KLT.DINV.WD.GD.ZS": "Foreign direct investment",
    "FR.INR.DPST": "Deposit interest rate",
    "BN.CAB.XOKA.GD.ZS": "Current account balance",
    "PA.NUS.FCRF": "Exchange rate",
    "EG.ELC.ACCS.ZS": "Total electricity access",
    "EG.ELC.ACCS.RU.ZS": "Rural electricity access",
    "EG.ELC.ACCS.UR.ZS": "Urban electricity access",
    "IT.NET.USER.ZS": "Internet users (%)",
    "EG.USE.COMM.FO.ZS": "Fossil fuel consumption",
    "EG.FEC.RNEW.ZS": "Renewable energy",
    "EG.ELC.RNEW.ZS": "Renewable electricity",
    "AG.LND.AGRI.ZS": "Agricultural land (%)",
    "AG.LND.FRST.ZS": "Forest area (% land)",
    "AG.YLD.CREL.KG": "Cereal yield (kg/hectare)",
    "AG.PRD.CROP.XD": "Crop production index",
    "ER.H2O.FWTL.K3": "Total freshwater withdrawal",
    "ER.H2O.FWST.ZS": "Freshwater withdrawal",
    "EN.ATM.PM25.MC.M3": "PM2.5 air pollution",
    "SG.GEN.PARL.ZS": "Female parliamentary seats (%)",
    "year_feature": "Year",
    "urbanization_rate": "Urbanization rate",
    "log_gdp_per_capita": "Log GDP per capita",
    "trade_openness": "Trade openness",
    "health_to_edu_ratio": "Health to education ratio",
    "gender_labor_gap": "Gender labor gap",
    "economic_diversity": "Economic diversity",
}

# fixed values: feature categories
CATEGORIES = {
    "gdp": [
        "NY.GDP.PCAP.CD",
        "NY.GDP.PCAP.PP.CD",
        "NY.GDP.MKTP.CD",
        "NY.GDP.MKTP.KD.ZG",
        "log_gdp_per_capita",
    ],
    "education": [
        "SE.PRM.ENRL",
        "SE.PRM.ENRL.FE.ZS",
        "SE.SEC.ENRL",
        "SE.SEC.ENRL.FE.ZS",
        "SE.TER.ENRL",
        "SE.XPD.TOTL.GD.ZS",
        "SE.PRM.CMPT.ZS",
        "SE.ADT.LITR.ZS",
    ],
    "health": [
        "SH.XPD.CHEX.GD.ZS",
        "SH.XPD.CHEX.PC.CD",
        "SH.DYN.MORT",
        "SH.DYN.NMRT",
        "SP.DYN.LE00.IN",
        "SH.DTH.COMM.ZS",
        "SH.STA.BASS.ZS",
        "health_to_edu_ratio",
    ],
    "labor": [
        "SL.TLF.CACT.ZS",
        "SL.TLF.CACT.FE.ZS",
        "SL.TLF.CACT.MA.ZS",
        "SL.UEM.TOTL.ZS",
        "SL.UEM.TOTL.FE.ZS",
        "SL.UEM.TOTL.MA.ZS",
        "SL.AGR.EMPL.ZS",
        "SL.IND.EMPL.ZS",
        "SL.SRV.EMPL.ZS",
        "gender_labor_gap",
    ],
    "demographics": [
        "SP.POP.TOTL",
        "SP.URB.TOTL",
        "SP.URB.TOTL.IN.ZS",
        "SP.POP.GROW",
        "SP.POP.65UP.TO.ZS",
        "SP.POP.0014.TO.ZS",
        "SP.DYN.TFRT.IN",
        "SP.DYN.CBRT.IN",
        "SP.DYN.CDRT.IN",
        "urbanization_rate",
    ],
    "trade": [
        "NE.EXP.GNFS.ZS",
        "NE.IMP.GNFS.ZS",
        "BX.KLT.DINV.WD.GD.ZS",
        "BN.CAB.XOKA.GD.ZS",
        "trade_openness",
    ],
    "government": [
        "GC.TAX.TOTL.GD.ZS",
        "GC.XPN.TOTL.GD.ZS",
        "GC.DOD.TOTL.GD.ZS",
        "MS.MIL.XPND.GD.ZS",
    ],
    "infrastructure": [
        "EG.ELC.ACCS.ZS",
        "IT.NET.USER.ZS",
        "IT.CEL.SETS.P2",
        "IS.ROD.PAVE.ZS",
    ],
    "economic_structure": [
        "NV.AGR.TOTL.ZS",
        "NV.IND.TOTL.ZS",
        "NV.SRV.TOTL.ZS",
        "NY.GDP.DEFL.KD.ZG",
        "FP.CPI.TOTL.ZG",
        "economic_diversity",
    ],
    "income_inequality": [
        "SI.POV.GINI",
        "SI.POV.NAHC",
    ],
    "other": [
        "year_feature",
    ],
}
# fixed values: model keys and their labels
MODEL_LABELS = {
    "decision_tree": "Decision Tree",
    "random_forest": "Random Forest",
    "gradient_boosting": "Gradient Boosting",
    "xgboost": "XGBoost",
    "lightgbm": "LightGBM",
}

# fixed values: default hyper-parameters
DEFAULTS = {
    "decision_tree": {"max_depth": 10, "min_samples_split": 10, "min_samples_leaf": 4},
    "random_forest": {
        "n_estimators": 200, "max_depth": 20, "min_samples_split": 5, "min_samples_leaf": 2, "max_features": "sqrt",
    },
    "gradient_boosting": {
        "n_estimators": 200, "learning_rate": 0.05, "max_depth": 5, "min_samples_split": 5, "min_samples_leaf": 2,
        "subsample": 0.9,
    },
    "xgboost": {
        "n_estimators": 200, "learning_rate": 0.05, "max_depth": 5, "min_child_weight": 3, "subsample": 0.9,
        "colsample_bytree": 0.9, "gamma": 0.1,
    },
    "lightgbm": {
        "n_estimators": 200, "learning_rate": 0.05, "max_depth": 5, "num_leaves": 50, "min_child_samples": 20,
        "subsample": 0.9, "colsample_bytree": 0.9, "reg_alpha": 0.1, "reg_lambda": 0.1,
    },
}

# fixed values: search grids
GRIDS = {
    "decision_tree": {
        "max_depth": [5, 10, None], "min_samples_split": [5, 10], "min_samples_leaf": [2, 4],
        "max_features": ["sqrt", None],
    },
    "random_forest": {
        "n_estimators": [100, 200], "max_depth": [15, 20, None], "min_samples_split": [2, 5],
        "min_samples_leaf": [1, 2], "max_features": ["sqrt", "log2"],
    },
    "gradient_boosting": {
        "n_estimators": [100, 200], "learning_rate": [0.05, 0.1], "max_depth": [3, 5], "min_samples_split": [2, 5],
        "min_samples_leaf": [1, 2], "subsample": [0.8, 0.9],
    },
    "xgboost": {
        "n_estimators": [100, 200], "learning_rate": [0.05, 0.1], "max_depth": [3, 5, 7], "min_child_weight": [1, 3],
        "subsample": [0.8, 0.9], "colsample_bytree": [0.8, 0.9], "gamma": [0, 0.1],
    },
    "lightgbm": {
        "n_estimators": [100, 200], "learning_rate": [0.05, 0.1], "max_depth": [3, 5, -1], "num_leaves": [31, 50],
        "min_child_samples": [20, 30], "subsample": [0.8, 0.9], "colsample_bytree": [0.8, 0.9],
        "reg_alpha": [0, 0.1], "reg_lambda": [0, 0.1],
    },
}

# fixed values: ensemble weights
ENSEMBLE_WEIGHTS = {
    "decision_tree": 0.05, "random_forest": 0.20, "gradient_boosting": 0.15, "xgboost": 0.30, "lightgbm": 0.30,
}

# fixed values: target bands (left-closed) and income quartile labels
TARGET_BANDS = [
    (0, 30, "Low Inequality (0-30)"), (30, 40, "Moderate Inequality (30-40)"),
    (40, 50, "High Inequality (40-50)"), (50, 100, "Very High Inequality (50+)"),
]
INCOME_LABELS = ["Low Income", "Lower-Middle Income", "Upper-Middle Income", "High Income"]

# fixed values: the shipped feature specs
FEATURE_SPECS = [
    {
        "name": "urbanization_rate", "operation": "ratio_scaled", "dependencies": ["SP.URB.TOTL", "SP.POP.TOTL"],
        "parameters": {"numerator": "SP.URB.TOTL", "denominator": "SP.POP.TOTL", "scale": 100},
    },
    {
        "name": "log_gdp_per_capita", "operation": "log1p", "dependencies": ["NY.GDP.PCAP.CD"],
        "parameters": {"source": "NY.GDP.PCAP.CD"},
    },
    {
        "name": "trade_openness", "operation": "sum", "dependencies": ["NE.EXP.GNFS.ZS", "NE.IMP.GNFS.ZS"],
        "parameters": {"columns": ["NE.EXP.GNFS.ZS", "NE.IMP.GNFS.ZS"]},
    },
    {
        "name": "health_to_edu_ratio", "operation": "ratio", "dependencies": ["SH.XPD.CHEX.GD.ZS", "SE.XPD.TOTL.GD.ZS"],
        "parameters": {"numerator": "SH.XPD.CHEX.GD.ZS", "denominator": "SE.XPD.TOTL.GD.ZS"},
    },
    {
        "name": "gender_labor_gap", "operation": "difference",
        "dependencies": ["SL.TLF.CACT.MA.ZS", "SL.TLF.CACT.FE.ZS"],
        "parameters": {"minuend": "SL.TLF.CACT.MA.ZS", "subtrahend": "SL.TLF.CACT.FE.ZS"},
    },
    {
        "name": "economic_diversity", "operation": "diversity",
        "dependencies": ["NV.AGR.TOTL.ZS", "NV.IND.TOTL.ZS", "NV.SRV.TOTL.ZS"],
        "parameters": {"columns": ["NV.AGR.TOTL.ZS", "NV.IND.TOTL.ZS", "NV.SRV.TOTL.ZS"]},
    },
]
