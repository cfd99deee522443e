"""Lists, names, patterns and texts that results depend on."""

# --- fixed values: concept lists -------------------------------------------------

PRIMARY_METRICS = [
    "Revenue",
    "NetIncomeLoss",
    "Assets",
    "Liabilities",
    "StockholdersEquity",
]

DETAILED_METRICS = [
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "CostOfGoodsAndServicesSold",
    "GrossProfit",
    "OperatingExpenses",
    "OperatingIncomeLoss",
    "EarningsPerShareBasic",
    "EarningsPerShareDiluted",
    "AssetsCurrent",
    "CashAndCashEquivalentsAtCarryingValue",
    "LiabilitiesCurrent",
    "CommonStockParOrStatedValuePerShare",
    "AccountsReceivableNetCurrent",
    "Inventory",
    "PropertyPlantAndEquipmentNet",
    "NetCashProvidedByUsedInOperatingActivities",
    "NetCashProvidedByUsedInInvestingActivities",
    "NetCashProvidedByUsedInFinancingActivities",
]

NAMESPACE_PRIORITY = ["us-gaap", "ifrs", "dei"]

REVENUE_TAG_PRIORITY = [
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "Revenues",
    "Revenue",
]

# --- fixed values: concept -> canonical tag --------------------------------------

CANONICAL_TAGS = {
    "Revenues": "revenue_total",
    "SalesRevenueNet": "revenue_total",
    "RevenueFromContractWithCustomerExcludingAssessedTax": "revenue_total",
    "NetSales": "revenue_total",
    "SalesRevenueGoodsNet": "revenue_goods",
    "SalesRevenueServicesNet": "revenue_services",
    "InterestAndDividendIncomeOperating": "revenue_interest_dividends",
    "TotalRevenueNetOfInterestExpense": "revenue_net_of_interest_expense",
    "CostOfGoodsAndServicesSold": "cost_of_goods_and_services_sold",
    "CostOfRevenue": "cost_of_revenue",
    "CostOfGoodsSold": "cost_of_goods_sold",
    "CostOfGoodsAndServiceExcludingDepreciationDepletionAndAmortization": "cogs_excl_d_and_a",
    "GrossProfit": "gross_profit",
    "OperatingIncomeLoss": "operating_income",
    "OperatingIncome": "operating_income",
    "NetIncomeLoss": "net_income",
    "ProfitLoss": "net_income",
    "EarningsPerShareBasic": "eps_basic_total",
    "IncomeLossFromContinuingOperationsPerBasicShare": "eps_basic_cont_ops",
    "EarningsPerShareDiluted": "eps_diluted_total",
    "IncomeLossFromContinuingOperationsPerDilutedShare": "eps_diluted_cont_ops",
    "ResearchAndDevelopmentExpense": "research_and_development_expense",
    "ResearchAndDevelopment": "research_and_development_expense",
    "ResearchAndDevelopmentExpenseCredit": "research_and_development_expense",
    "SellingGeneralAndAdministrativeExpense": "selling_general_admin_expense",
    "GeneralAndAdministrativeExpense": "general_admin_expense",
    "IncomeTaxExpenseBenefit": "income_tax_expense",
    "CurrentIncomeTaxExpenseBenefit": "current_income_tax_expense",
    "ProvisionForIncomeTaxes": "income_tax_expense",
    "NetCashProvidedByUsedInOperatingActivities": "cash_flow_from_operations",
    "NetCashProvidedByUsedInInvestingActivities": "cash_flow_from_investing",
    "NetCashProvidedByUsedInFinancingActivities": "cash_flow_from_financing",
    "CapitalExpenditures": "capital_expenditures",
    "PaymentsToAcquirePropertyPlantAndEquipment": "capital_expenditures",
    "PaymentsToAcquireOtherPropertyPlantAndEquipment": "capital_expenditures",
    "RepurchaseOfCommonStock": "share_repurchases",
    "PaymentsForRepurchaseOfCommonStock": "share_repurchases",
    "AcceleratedShareRepurchasesSettlementPaymentOrReceipt": "share_repurchases",
    "StockRepurchasedAndRetiredDuringPeriodValue": "share_repurchases",
    "CashAndCashEquivalentsAtCarryingValue": "cash_and_cash_equivalents",
    "CashCashEquivalentsAndShortTermInvestments": "cash_equiv_and_short_term_investments",
    "AccountsReceivableNet": "accounts_receivable_net",
    "AccountsAndNotesReceivableNet": "accounts_and_notes_receivable_net",
    "AccountsReceivableNetCurrent": "accounts_receivable_current",
    "InventoryNet": "inventory_net",
    "InventoryFinishedGoodsAndWorkInProcess": "inventory_finished_goods_wip",
    "AccountsPayableCurrent": "accounts_payable_current",
    "AccountsPayableTradeCurrent": "accounts_payable_trade_current",
    "Assets": "assets_total",
    "AssetsNet": "assets_total_net",
    "AssetsCurrent": "assets_current",
    "Liabilities": "liabilities_total",
    "LiabilitiesCurrent": "liabilities_current",
    "StockholdersEquity": "stockholders_equity",
    "LongTermDebtAndCapitalLeaseObligations": "long_term_debt_and_capital_leases",
    "LongTermDebt": "long_term_debt",
    "DebtCurrent": "debt_current",
    "CommercialPaper": "commercial_paper",
    "ShortTermBorrowings": "short_term_borrowings",
    "CurrentPortionOfLongTermDebt": "current_portion_long_term_debt",
    "LongTermDebtCurrent": "current_portion_long_term_debt_alt",
    "FinanceLeaseLiabilityCurrent": "finance_lease_liability_current",
    "FinanceLeaseLiabilityNoncurrent": "finance_lease_liability_non_current",
    "Debt": "debt_total",
    "Goodwill": "goodwill",
}

# --- fixed values: addresses -----------------------------------------------------

ARCHIVE_URL = "https://www.sec.gov/Archives/"
SITE_URL = "https://www.sec.gov"
ARCHIVE_MARK = "/Archives/edgar/data/"

# --- fixed values: document sections ---------------------------------------------
# (id, pattern from the heading to the nearest end marker, display name); `W` stands for a run of
# white space, which covers the no-break space as well.

W = r"[\s\x1c-\x1f]"

SECTION_PATTERNS = [
    ("business_description", rf"Item{W}+1\.?{W}*Business.+?Item{W}+1A", "Business Description"),
    ("risk_factors", rf"Item{W}+1A\.?{W}*Risk{W}+Factors.+?Item{W}+1B", "Risk Factors"),
    (
        "mda",
        rf"Item{W}+7\.?{W}*Management's{W}+Discussion.+?Item{W}+7A",
        "Management Discussion & Analysis",
    ),
    (
        "financial_statements",
        rf"Item{W}+8\.?{W}*Financial{W}+Statements.+?Item{W}+9",
        "Financial Statements",
    ),
]

FOOTNOTES_PATTERN = (
    "footnotes",
    rf"Notes{W}+to{W}+(?:Consolidated{W}+)?Financial{W}+Statements.+?(?:Signatures|Item{W}+9)",
    "Notes to Financial Statements",
)
NOTE_PATTERN = rf"(Note{W}+\d+[\.:]{W}*[A-Z][^\.]+\.)(.+?)(?=Note{W}+\d+[\.:]{W}*[A-Z]|$)"

SEGMENT_PATTERN = (
    "segment_info",
    rf"Segment{W}+(?:Information|Data|Results).+?(?:\d+{W}+Table{W}+of{W}+Contents|\d+)",
    "Segment Information",
)

# --- fixed values: document titles -----------------------------------------------

NO_HEADING_TITLE = "Document Start"
BLANK_HEADING_TITLE = "Untitled Section"

# --- fixed values: filing content texts ------------------------------------------

BASIC_INFO_TEXT = "Filing: {ticker} {form} dated {date}"
METRICS_HEAD = "Key Financial Metrics for {ticker} as of {date}:\n\n"
METRICS_LINE = "• {name}: {value} {unit} (Period: {start} to {end})\n"
DERIVED_HEAD = "Derived Financial Metrics for {ticker}:\n\n"
DERIVED_EQUITY_LINE = "• Derived Equity (Assets - Liabilities): {value} {unit}\n"
DERIVED_MARGIN_LINE = "• Net Profit Margin: {value}%\n"
ERROR_TEXT = "Error processing {ticker} {form} from {date}."

NO_TEXT_MESSAGE = "No text content provided."
NO_BODY_MESSAGE = "No 10-K text content found in the filing."

# (feature that asks for it, section id, section name, text)
PLACEHOLDERS = [
    (
        None,
        "overview",
        "Filing Overview",
        "{ticker} {form} filed on {date}. Filing content is not available for detailed processing.",
    ),
    (
        "primary_financials",
        "financial_metrics",
        "Financial Metrics",
        "Key financial metrics for {ticker} as reported in the {form}.",
    ),
    (
        "sections",
        "business_description",
        "Business Description",
        "Description of {ticker}'s business operations and markets.",
    ),
    (
        "sections",
        "risk_factors",
        "Risk Factors",
        "Key risks facing {ticker} as disclosed in the {form}.",
    ),
    (
        "sections",
        "mda",
        "Management Discussion & Analysis",
        "Management's discussion and analysis of {ticker}'s financial condition and results"
        " of operations.",
    ),
    (
        "footnotes",
        "footnotes",
        "Notes to Financial Statements",
        "Notes to financial statements for {ticker}, including accounting policies.",
    ),
    (
        "segments",
        "segment_info",
        "Segment Information",
        "Information about {ticker}'s operating segments and geographical regions.",
    ),
]

# --- fixed values: sizes ---------------------------------------------------------

EARLIEST_YEAR = 1995
DEFAULT_YEARS_BACK = 10
PARAGRAPH_CHUNK = 1500
WINDOW_SIZE = 1000
WINDOW_OVERLAP = 100
TRUNCATE_AT = 200
SEARCH_LIMIT = 10
LISTING_LIMIT = 100
INDEX_PARTITIONS = 256
EMBEDDING_DIM = 3072
