"""Instrument rules, name tables, lists and line constants.

Each instrument rule is (pattern, result, options). Matching ignores case, uses the first match in
the text with separators turned into spaces (``src="raw"``: the text as given), and the first rule
that yields a value wins. ``{1}`` is the captured text, ``{n}`` the captured integer. Options:
``unless`` a pattern that must not occur, ``cases`` ranges (lo, hi, result) for the captured
integer - outside all of them the next rule is tried.
"""

from dataclasses import dataclass


BIG = 10**9

TELESCOPE_RULES = [
    (r"@OHP\s*193", "OHP_T193"),
    (r"@OHP", "OHP"),
    (r"@TBL", "PicDuMidi_TBL"),
    (r"@TNG", "TNG_3.6m"),
    (r"@ESO\s*([\d.]+)", "ESO_{1}m"),
    (r"Feros@ESO([\d.]+)", "ESO_{1}m", {"src": "raw"}),
    (r"(?:Celestron\s*)?C\s*14(?=[^0-9]|$)", "C14"),
    (r"(?:Celestron\s*)?C\s*11(?=[^0-9]|$)", "C11"),
    (r"(?:Celestron\s*)?C\s*10(?=[^0-9]|$)", "C10"),
    (r"(?:Celestron\s*)?C\s*9\.?25(?=[^0-9]|$)", "C9"),
    (r"(?:Celestron\s*)?C\s*9(?=[^0-9]|$)", "C9"),
    (r"(?:Celestron\s*)?C\s*8(?=[^0-9]|$)", "C8"),
    (r"(?:Celestron\s*)?C\s*5(?=[^0-9]|$)", "C5"),
    (r"Edge\s*(?:HD)?\s*(\d+)", "C{1}"),
    (r"(\d+)\s*(?:inch|in|\")?\s*Edge\s*HD", "C{1}"),
    (r"SC\s*(\d+)(?=[^0-9]|$)", None, {"cases": [(15, 25, "SC{n}"), (0, 14, "C{n}")]}),
    (r"SCT\s*0?\.(\d+)\s*m", "SCT_{1}cm"),
    (r"RC\s*(\d{2,3})(?=[^0-9]|$)", "RC{n}"),
    (r"RCO\s*(\d+)", "RC{1}"),
    (r"RCX\s*(\d+)", "RC{1}"),
    (r"Astrosib", "Astrosib", {"unless": r"RC"}),
    (r"CDK\s*(\d+)", "CDK{1}"),
    (r"(?<![a-z])CDK(?=[^0-9a-z]|$)", "CDK"),
    (r"FSQ\s*106", "Takahashi_FSQ106"),
    (r"FSQ\s*85", "Takahashi_FSQ85"),
    (r"FS\s*128", "Takahashi_FS128"),
    (r"TSA\s*120", "Takahashi_TSA120"),
    (r"Mewlon\s*210", "Takahashi_Mewlon210"),
    (r"Mewlon\s*180", "Takahashi_Mewlon180"),
    (r"R\s*128", "Takahashi_R128"),
    (r"VC\s*200\s*L?", "Vixen_VC200L"),
    (r"VMC\s*200", "Vixen_VMC200"),
    (r"R200SS", "Vixen_R200SS"),
    (r"(?:NEWTON|Newton|Newt|NW|Nwt)\s*(\d{2,4})", None,
     {"cases": [(0, 29, "Newton_{n}inch"), (30, BIG, "Newton_{n}mm")]}),
    (r"(?<![a-z])N\s*(\d{3})(?=[^0-9]|$)", "Newton_{1}mm", {"unless": r"NO[UV]|Neo|Nova|Nik"}),
    (r"(\d+)\s*(?:in|inch)?\s*(?:Newt|Newton)", None,
     {"cases": [(0, 29, "Newton_{n}inch"), (30, BIG, "Newton_{n}mm")]}),
    (r"LX\s*200", "Meade_LX200"),
    (r"LX\s*254", "Meade_LX254"),
    (r"LX\s*90", "Meade_LX90"),
    (r"MEADE\s*(\d+)\s*mm", "Meade_{1}mm"),
    (r"MEADE\s*(\d+)", None, {"cases": [(0, 20, "Meade_{n}inch"), (21, BIG, "Meade_{n}mm")]}),
    (r"(?<![a-z])T\s*1000(?=[^0-9]|$)", "T1000"),
    (r"(?<![a-z])T\s*600(?=[^0-9]|$)", "T600"),
    (r"(?<![a-z])T\s*520(?=[^0-9]|$)", "T520"),
    (r"(?<![a-z])T\s*500(?=[^0-9]|$)", "T500"),
    (r"(?<![a-z])T\s*400(?=[^0-9]|$)", "T400"),
    (r"(?<![a-z])T\s*350(?=[^0-9]|$)", "T350"),
    (r"(?<![a-z])T\s*300(?=[^0-9]|$)", "T300"),
    (r"(?<![a-z])T\s*254(?=[^0-9]|$)", "T254"),
    (r"(?<![a-z])T\s*250(?=[^0-9]|$)", "T250"),
    (r"(?<![a-z])T\s*200(?=[^0-9]|$)", "T200"),
    (r"(?<![a-z])T\s*193(?=[^0-9]|$)", "OHP_T193"),
    (r"(?<![a-z])T\s*190(?=[^0-9]|$)", "T190"),
    (r"(?<![a-z])T\s*152(?=[^0-9]|$)", "OHP_T152"),
    (r"(?<![a-z])T\s*150(?=[^0-9]|$)", "T150"),
    (r"(?<![a-z])T\s*120(?=[^0-9]|$)", "OHP_T120"),
    (r"(?<![a-z])T\s*80(?=[^0-9]|$)", "OHP_T80"),
    (r"(?<![a-z])T\s*62(?=[^0-9]|$)", "OHP_T62"),
    (r"(?<![a-z])T\s*60(?=[^0-9]|$)", "PicDuMidi_T60"),
    (r"(?<![a-z])T\s*0\.(\d+)", "T{fraction_mm}mm"),
    (r"IAC\s*80", "IAC80"),
    (r"C2PU", "C2PU_T1000"),
    (r"Pic\s*of the\s*Midi", "PicDuMidi_T60"),
    (r"GEMINI", "Gemini"),
    (r"(\d+)\s*cm\s*DK", "DK_{1}cm", {"src": "raw"}),
    (r"DK\s*(\d+)", None, {"cases": [(101, BIG, "DK_{n}mm"), (0, 100, "DK_{n}cm")]}),
    (r"CEDES\s*(\d+)", "CEDES_{1}cm"),
    (r"Askar\s*(\d+)", "Askar_{1}"),
    (r"AP\s*130", "AP130"),
    (r"AP\s*115", "AP115"),
    (r"Esprit\s*(\d+)", "Esprit_{1}"),
    (r"APM\s*(\d+)", "APM_{1}"),
    (r"MAK\s*(\d+)", "Mak{1}"),
    (r"MTO\s*(\d+)", "MTO_{1}"),
    (r"FRA\s*(\d+)", "FRA_{1}"),
    (r"EB\s*([123])", "EB{1}"),
    (r"CN\s*212", "CN212"),
    (r"CC\s*13", "CC13"),
    (r"OMC\s*(\d+)", "OMC{1}"),
    (r"TSC\s*(\d+)", "TSC_{1}"),
    (r"Perl", "Perl"),
    (r"Sky\s*Watcher\s*(\d+)", "SkyWatcher_{1}", {"first_of": r"Sky\s*Watcher\s*(\d+)?"}),
    (r"Sky\s*Watcher", "SkyWatcher"),
    (r"(?<![a-z])SW\s*(\d+)", "SkyWatcher_{1}", {"unless": r"SWP|SX", "unless_src": "raw"}),
    (r"(?<![a-z])M\s*(\d{2,3})(?=[^0-9]|$)", None,
     {"cases": [(12, 12, "M{n}"), (14, 14, "M{n}"), (250, 250, "M{n}"), (603, 603, "M{n}"), (703, 703, "M{n}")]}),
    (r"ACF\s*(\d+)", "Meade_ACF{1}"),
    (r"Vixen", "Vixen"),
    (r"Intes", "Intes"),
    (r"(\d{2,3})\s*ED", "ED{1}"),
    (r"ED\s*(\d{2,3})", "ED{1}"),
    (r"(?<![a-z])TS\s*(\d{2,3})(?=[^0-9]|$)", None, {"cases": [(0, 199, "TS{n}")]}),
    (r"LU\s*(\d+)", "Lunette_{1}mm"),
    (r"Lunette\s*(\d+)", "Lunette_{1}mm"),
    (r"(?:^|[\s])0?\.(\d+)\s*m(?=[^a-z]|$)", "T{fraction_cm}cm"),
    (r"(?:^|[\s])(\d{2,3})\s*cm(?=[^a-z]|$)", "T{1}cm"),
    (r"(\d{3})\s*mm", None, {"cases": [(100, 800, "T{n}mm")]}),
    (r"Cassegrain\s*0?\.(\d+)\s*m", "Cass_{fraction_cm}cm"),
    (r"Cassegrain\s*(\d+)", None, {"cases": [(0, 99, "Cass_{n}cm"), (100, BIG, "Cass_{n}mm")]}),
    (r"(\d+)[\"″]", None, {"cases": [(5, 25, "T{n}inch")]}),
]

SPECTROGRAPH_RULES = [
    (r"Elodie", "Elodie", {"src": "raw"}),
    (r"SOPHIE", "SOPHIE", {"src": "raw"}),
    (r"Feros", "FEROS", {"src": "raw"}),
    (r"(?:Whop+shel|e[\s]?shel)", "eShel"),
    (r"l[hi]+res", "LhiresIII"),
    (r"LH\s*(?:3|III)", "LhiresIII"),
    (r"(?<![a-z])LH\s*\d{3,4}", "LhiresIII"),
    (r"(?<![a-z])L\s*3(?=[^0-9]|$)", "LhiresIII"),
    (r"Alpy\s*(\d+)", "Alpy{1}", {"first_of": r"Alpy\s*(\d+)?"}),
    (r"Alpy", "Alpy600"),
    (r"(?<![a-z])LISA(?=[^a-z]|$)", "LISA"),
    (r"star[\s'’]*ex", "StarEx"),
    (r"solex", "SolEx"),
    (r"star\s*anal", "StarAnalyser"),
    (r"(?<![a-z])SA\s*(?:100|200)", "StarAnalyser"),
    (r"uvex", "UVEX"),
    (r"dados", "Dados"),
    (r"VHIRES", "VHIRES"),
    (r"(?:Spectra[\s]?)?L[\s]?200(?=[^0-9]|$)", "Spectra_L200", {"unless": r"LX\s*200"}),
    (r"lowsp|lowres", "LowSpec"),
    (r"bespectra", "BeSpectra"),
    (r"echelle[\s]?CB", "Echelle_CB"),
    (r"dubs[\s]?echelle", "Dubs_echelle"),
    (r"SPECTRO[\s]?200", "Spectro200"),
    (r"slit[\s]?spec", "SlitSpec"),
    (r"(?<![a-z])SGS(?=[^a-z]|$)", "SGS"),
    (r"SPOX", "SPOX"),
    (r"Rainbow", "RainbowOptics"),
    (r"Littrow", "Littrow"),
    (r"Bardin", "Bardin"),
    (r"JOSIANE", "JOSIANE"),
    (r"MEDRES", "MEDRES"),
    (r"SARDHIRES", "SARDHIRES"),
    (r"Merlette", "Merlette"),
    (r"homemade|DIY|custom", "Homemade"),
    (r"NOU", "NOU_T"),
    (r"HARPS", "HARPS"),
    (r"UVES", "UVES"),
    (r"X[\s]?Shooter", "X-Shooter"),
    (r"AURELIE", "AURELIE"),
    (r"MUSICOS", "MUSICOS"),
    (r"CARELEC", "CARELEC"),
    (r"Veloce", "Veloce"),
    (r"(?<![a-z])Neo(?=[^a-z]|$)", "Neo"),
    (r"SARG", "SARG"),
    (r"GIRAFFE|FLAMES", "FLAMES_GIRAFFE"),
    (r"GEMINI.*?HR", "Gemini_HR"),
    (r"DeniSe", "DeniSe", {"src": "raw"}),
    (r"MUSSOL", "MUSSOL", {"src": "raw"}),
    (r"PIERA", "PIERA", {"src": "raw"}),
    (r"ESSAT", "ESSAT"),
    (r"(?<![a-z])ESP(?=[^a-z]|$)", "ESP"),
    (r"LINX", "LINX"),
    (r"REMOT", "REMOT"),
    (r"IUE[\s]?SWP", "IUE_SWP"),
    (r"IUE[\s]?LWP", "IUE_LWP"),
    (r"IUE[\s]?LWR", "IUE_LWR"),
    (r"echelle", "Echelle", {"unless": r"eshel|CB|dubs"}),
    (r"[A-Z]\d+S(\d+)$", "Compact_R{1}", {"src": "raw_trimmed"}),
    (r"[\s](\d{3,4})\s*$", "Unknown_grating"),
]

DETECTOR_RULES = [
    (r"(?:ATIK|ATK)\s*(\d+)", "Atik{1}"),
    (r"Atik\s*L(?=[^0-9]|$)", "AtikL"),
    (r"(?:ZWO\s*)?ASI\s*(\d+)", "ASI{1}"),
    (r"QSI\s*(\d+)", "QSI{1}"),
    (r"QHY\s*(?:IMG)?\s*(\d+)", "QHY{1}"),
    (r"SBIG\s*(?:ST\s*)?(\d+)", "SBIG_ST{1}"),
    (r"(?<![a-z])ST\s*(\d{1,5})(?:XME|ME|M)?(?=[^0-9]|$)", "SBIG_ST{1}",
     {"not_after": ["ESSA", "ES", "ESS"], "not_after_chars": 4}),
    (r"Audine\s*(?:KAF\s*)?(\d+)?", "Audine{1}"),
    (r"KAF\s*(\d+)", "KAF{1}"),
    (r"(?:TRIUS|Trius)\s*(?:SX)?\s*[A-Z]?\s*(\d+)", "Trius_{1}"),
    (r"SXVR\s*H\s*(\d+)", "SXVR_H{1}"),
    (r"SXV\s*[MH]\s*(\d+)", "SXVR_{1}"),
    (r"(?<![a-z])SX\s*(\d+)", "SX_{1}"),
    (r"FLI\s*(?:ML)?\s*(\d+)", "FLI_ML{1}"),
    (r"(?<![a-z])ML\s*(\d+)", "FLI_ML{1}"),
    (r"CCD\s*(\d+)", "CCD{1}"),
    (r"DSI", "Meade_DSI"),
    (r"Nova\s*(\d+)", "Nova{1}"),
    (r"(?<![a-z])MX\s*(\d+)", "MX{1}"),
    (r"Canon\s*(\d+)", "Canon{1}"),
    (r"Nikon", "Nikon"),
    (r"HISIS", "HISIS"),
    (r"TH\s*7852", "TH7852"),
    (r"iKon", "Andor_iKon"),
    (r"Andor", "Andor"),
    (r"Moravian", "Moravian"),
    (r"ARES", "ARES"),
    (r"ILX\s*511", "ILX511"),
    (r"ST[LF]\s*(\d+)", "SBIG_STL{1}"),
]

# Spectrographs of professional sites and the telescope they imply (None: stated in the text).
IMPLIED_TELESCOPE = {
    "SOPHIE": "OHP_T193", "Elodie": "OHP_T193", "FEROS": None, "HARPS": "ESO_3.6m",
    "UVES": "ESO_VLT", "X-Shooter": "ESO_VLT", "AURELIE": "OHP_T152", "CARELEC": "OHP_T152",
    "MUSICOS": "PicDuMidi_TBL", "Veloce": "AAO_3.9m", "SARG": "TNG_3.6m",
    "FLAMES_GIRAFFE": "ESO_VLT", "IUE_SWP": "IUE", "IUE_LWP": "IUE", "IUE_LWR": "IUE",
}

INTEGRATED_SETUPS = ["DeniSe", "MUSSOL", "PIERA", "NOU_T", "LINX", "REMOT", "ESP", "ESSAT", "Spectro200"]

PROFESSIONAL_SPECTROGRAPHS = [
    "Elodie", "SOPHIE", "Aurelie", "MUSICOS", "NARVAL", "FEROS", "HARPS", "UVES", "X-shooter",
    "ESPaDOnS", "SARG", "IUE_SWP", "IUE_LWP", "HEROS", "FIES", "HERMES", "CAFE", "BESO",
]

ECHELLE_SPECTROGRAPHS = ["Elodie", "MUSICOS", "VHIRES", "eShel", "ESP", "FEROS", "DeniSe", "Dubs_echelle"]

GREEK = {
    "ALPHA": "ALF", "BETA": "BET", "GAMMA": "GAM", "DELTA": "DEL", "EPSILON": "EPS", "ZETA": "ZET",
    "ETA": "ETA", "THETA": "TET", "IOTA": "IOT", "KAPPA": "KAP", "LAMBDA": "LAM", "MU": "MU",
    "NU": "NU", "XI": "XI", "OMICRON": "OMI", "PI": "PI", "RHO": "RHO", "SIGMA": "SIG",
    "TAU": "TAU", "UPSILON": "UPS", "PHI": "PHI", "CHI": "CHI", "PSI": "PSI", "OMEGA": "OME",
}

CATALOG_PREFIXES = ["HD", "HR", "SAO", "HIP", "MWC", "ADS", "TYC", "NSV", "NGC", "BD", "CD", "CPD"]

# Rewrites of an object name, in this order.
NAME_REWRITES = [
    (r"^(" + "|".join(CATALOG_PREFIXES) + r")\s+", "$1"),
    (r"^V\s+(\d)", "V$1"),
    (r"^V0+(\d{1,4}\s)", "V$1"),
    (r"^V0+(\d{1,4})$", "V$1"),
    (r"^(\d+)([A-Z]{3})$", "$1 $2"),
    (r"[\-\+\*]+$", ""),
]

LEAK_PATTERNS = ["/share/home", "/home/", "/users/"]

# Line centres in angstrom.
LINES = {
    "Halpha": 6562.8, "Hbeta": 4861.3, "Hgamma": 4340.5, "Hdelta": 4101.7,
    "HeI_5876": 5876.0, "FeII_5169": 5169.0, "NaD": 5893.0, "OI_7772": 7772.0,
}

CONTINUUM_WINDOWS = [(4000, 4100), (4550, 4650), (5400, 5500), (5800, 5870), (6100, 6200),
                     (6380, 6470), (6730, 6800)]

PROFILE_CLASSES = ["absorption_pure", "single_peak", "double_peak", "double_asym", "shell"]

SPEED_OF_LIGHT_KMS = 299792.458


@dataclass(frozen=True)
class ExemplarRules:
    """Fixed values of the exemplar scores. Windows are bins (first, end) of a 128-bin vector over ``low`` to
    ``high`` angstrom; the core reaches ``core`` bins on either side of the line centre."""

    low: float = 6530.0
    high: float = 6595.0
    bins: int = 128
    core: int = 4
    edge: int = 5
    noise: tuple[int, int] = (105, 120)
    blue_level: tuple[int, int] = (5, 20)
    red_level: tuple[int, int] = (108, 123)
    emission: float = 1.05
    least_depth: float = 0.03
    least_core: float = 0.98
    least_dip: float = 0.25
    most_drift: float = 0.012
    drift_weight: float = 10.0
    shell_bonus: float = 1.5
