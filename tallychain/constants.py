"""Fixed values. They identify on-chain things, so results depend on them literally."""

from datetime import date

# Labels of the two execution environments and of their combination.
NATIVE_LABEL = "Cadence"
EVM_LABEL = "EVM"
BOTH_LABEL = "EVM + Cadence"

# First day of the "all time" period.
EPOCH_START = date(2020, 1, 1)

# Native fee events.
FEE_CONTRACT = "A.f919ee77447b7497.FlowFees"
FEE_EVENT = "FeesDeducted"

# Native event that announces a newly deployed contract.
CONTRACT_ADDED_EVENT = "AccountContractAdded"

# Log topic that marks the owner of a fresh EVM contract, and the init-code
# signatures that mark a deployment without such a log.
DEPLOY_TOPIC = "0x8be0079c531659141344cd1fd0a4f28419497f9722a3daafe3b4186f6b6457e0"
INIT_SIGNATURES = ("0x60c06040", "0x60806040")

# Address prefix of EVM accounts that are owned by a native account.
COA_PREFIX = "0x0000000000000000000000020000000000000000"

# Staking actions that lock tokens and that release them.
COMMIT_ACTIONS = ("DelegatorTokensCommitted", "TokensCommitted")
WITHDRAW_ACTIONS = ("UnstakedTokensWithdrawn", "DelegatorUnstakedTokensWithdrawn")

# Supply series: token symbol, stake held before the first staking row, liquid
# staking amount (no source reports it).
TOKEN_SYMBOL = "FLOW"
STAKED_BASE = 1.6e8
LIQUID_SUPPLY = 0.0

# Weeks shown in the new-address table, and rows of a rolling mean.
WEEK_TABLE_WEEKS = 12
ROLLING_ROWS = 4

# Row labels of the new-address table, by measure.
WEEK_TABLE_ROWS = {
    "cadence_accounts": "# transacting wallets on Cadence",
    "cadence_pct": "Cadence % Change",
    "evm_accounts": "# transacting wallets on EVM",
    "evm_pct": "EVM % Change",
    "total_accounts": "# total transacting wallets",
    "total_pct": "Total % Change",
}
